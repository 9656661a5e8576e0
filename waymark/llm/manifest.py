"""Merkle manifest of a dataset, with a witness for every row.

Rows of a key (a source) are leaves in order of their id, sixteen nodes make one above, and the
keys' roots are leaves of one more tree. Nodes are appended from left to right. A run of siblings
that is still open holds the partial witnesses of everything below it: witnesses are attached to
subtrees, not copied to leaves, and when a run gets its last sibling all of them are extended by
that run at once and the run's digest is appended one level up.

Appending is distributed by aligned blocks of ``FAN ** DEPTH`` leaves: the first of a block starts
a subtree of its own, so each task appends the leaves of its blocks and ends with block roots.
Block roots are appended in the same way, and so on; every step shrinks the table 256 times.
Going back down, a block meets the witness of its root and extends those of its nodes by it. No
task holds more than a block and its witness, and neither a hot key nor many keys meet in one.

Edge cases: a null field is written `-`, an empty one `0:`; a null key is a key of its own, first
in order; null ids come first, equal ids are ordered by their leaves, repeated rows are leaves one
by one; a key with a single leaf has it for its root; an empty table has no rows and no root; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import cut, numbered

FAN = 16
DEPTH = 2  # levels within a block
BLOCK = FAN**DEPTH
HEX = 64  # characters of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("others", T.StringType())]))  # levels: place among siblings, the others' digests
WITNESS = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.string())]))


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: every value as its byte count, a colon and itself, or `-`."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*told).cast("binary"), 256)


class Subtree:
    """An aligned block under construction: appended nodes, and the runs that closed so far."""

    def __init__(self, first: bool):
        self.first = first  # block 0 may be the whole tree and then ends where one node is left
        self.open: list[list[str]] = [[] for _ in range(DEPTH + 1)]
        self.closed: list[list[str]] = [[] for _ in range(DEPTH)]  # per level, the digests of each closed run

    def append(self, node: str, level: int = 0) -> None:
        self.open[level].append(node)
        if level < DEPTH and len(self.open[level]) == FAN:
            self._close(level)

    def _close(self, level: int) -> None:
        """The run is complete: it extends the witnesses of its subtree, and its digest goes up."""
        run, self.open[level] = "".join(self.open[level]), []
        self.closed[level].append(run)
        self.append(digest(run), level + 1)

    def root(self) -> str:
        """Closes what is open and returns the one node left."""
        for level in range(DEPTH):
            if self.open[level] and (not self.first or self.closed[level] or len(self.open[level]) > 1):
                self._close(level)
        return next(run[0] for run in reversed(self.open) if run)

    def witness(self, at: int) -> list[tuple[int, str]]:
        """The levels that a leaf of the block has seen closed."""
        out = []
        for runs in self.closed:
            if not runs:
                break
            run, place = runs[at // FAN], at % FAN
            out.append((place, run[: HEX * place] + run[HEX * (place + 1):]))
            at //= FAN
        return out


def _appending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, block, pos, node) in order to (key, pos, node): the roots of the blocks."""
    now, tree = None, None
    for batch in batches:
        done = []
        for key, block, node in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (key, block) != now:
                if tree is not None:
                    done.append((*now, tree.root()))
                now, tree = (key, block), Subtree(block == 0)
            tree.append(node)
        yield _roots(done)
    if tree is not None:
        yield _roots([(*now, tree.root())])


def _roots(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["key", "pos", "node"])


def _extending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of blocks, each block led by a row (pos -1) with its root's witness, to the nodes' witnesses."""
    held: pa.Table | None = None
    for batch in batches:
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        if not held.num_rows:
            continue
        heads = [i for i, p in enumerate(held.column("pos").to_pylist()) if p < 0]
        if heads and heads[-1]:
            yield _extended(held.slice(0, heads[-1]).combine_chunks())
            held = held.slice(heads[-1]).combine_chunks()
    if held is not None and held.num_rows:
        yield _extended(held.combine_chunks())


def _extended(table: pa.Table) -> pa.RecordBatch:
    blocks, places, nodes, above, roots = (table.column(c).to_pylist() for c in ("block", "pos", "node", "above", "subroot"))
    kept, witnesses, subroots = [], [], []
    heads = [i for i, p in enumerate(places) if p < 0]
    for head, end in zip(heads, [*heads[1:], len(places)]):
        tree = Subtree(blocks[head] == 0)
        for node in nodes[head + 1:end]:
            tree.append(node)
        tree.root()
        upper = [(step["at"], step["others"]) for step in above[head]]
        for at in range(end - head - 1):
            kept.append(head + 1 + at)
            witnesses.append([{"at": p, "others": o} for p, o in (*tree.witness(at), *upper)])
            subroots.append(roots[head])
    rows = table.drop_columns(["block", "above", "subroot"]).take(pa.array(kept, pa.int64())).combine_chunks()
    out = rows.append_column("subroot", pa.array(subroots, pa.string())).append_column("witness", pa.array(witnesses, WITNESS))
    return out.to_batches()[0] if kept else pa.RecordBatch.from_pylist([], out.schema)


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("key", "block").sortWithinPartitions("key", "block", "pos")


def grow(nodes: DataFrame) -> list[DataFrame]:
    """Trees of every key over (key, pos, node): the nodes, their block roots, and so on to one row a key."""
    stages = [nodes]
    while True:
        blocks = stages[-1].select("key", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "node")
        stages.append(cut(_in_blocks(blocks).mapInArrow(_appending, "key string, pos long, node string"), "roots"))
        if stages[-1].where("pos > 0").isEmpty():
            return stages


def extend(stages: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first stage's rows with ``subroot`` and ``witness``; ``tops``: (key, above, subroot) of every key.

    Every stage's witnesses are written before the next one reads them, all but the last.
    """
    heads = tops.select("key", F.lit(0).cast("long").alias("block"), "above", "subroot")
    for level in range(len(stages) - 2, -1, -1):
        nodes = stages[level]
        rows = nodes.select(F.expr(f"pos div {BLOCK}").alias("block"), "*", F.lit(None).cast(STEPS).alias("above"), F.lit(None).cast("string").alias("subroot"))
        led = rows.unionByName(heads.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
        kinds = T.StructType([T.StructField(f.name, f.dataType) for f in nodes.schema.fields]).add("subroot", T.StringType()).add("witness", STEPS)
        out = _in_blocks(led).mapInArrow(_extending, kinds)
        if level:
            heads = cut(out, "witnesses").select("key", F.col("pos").alias("block"), F.col("witness").alias("above"), "subroot")
    return out


def witnesses(docs: DataFrame, fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, ``carry``, pos, leaf, subroot, root and its witness up to the root.

    ``fields`` begins with the id and the key; ``carry`` has more columns over ``docs``, which pass through.
    A witness is an array of levels, from the leaf up: place among the siblings, and the digests of the others.
    """
    carry = carry or {}
    more = [c.alias(f"c{i}") for i, c in enumerate(carry.values())]
    doc_id, key = F.col(f"`{fields[0]}`"), F.col(f"`{fields[1]}`").cast("string")
    leaves = docs.select(
        F.when(key.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), key)).alias("key"), doc_id.cast("long").alias("doc_id"), leaf_digest([F.col(f"`{f}`") for f in fields]).alias("node"), *more
    )
    nodes = cut(numbered(cut(leaves, "leaves"), ["key"], [F.col("doc_id"), F.col("node")], "pos"), "leaves")
    stages = grow(nodes)
    roots = stages[-1].select("node", F.col("key").alias("of"))
    sources = cut(numbered(cut(roots, "subroots"), [], [F.col("of")], "pos").withColumn("key", F.lit("")), "subroots")
    upper = grow(sources)
    top = upper[-1].select("key", F.array().cast(STEPS).alias("above"), F.lit("").alias("subroot"))
    whole = upper[-1].select(F.col("node").alias("root"))
    tops = cut(extend(upper, top).select(F.col("of").alias("key"), F.col("witness").alias("above"), F.col("node").alias("subroot")), "tops")
    root = (whole.first() or [None])[0]
    own = [F.col(f"c{i}").alias(n) for i, n in enumerate(carry)]
    return extend(stages, tops).select("doc_id", *own, "pos", F.col("node").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "witness")


def fold(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and a witness give."""
    put = lambda node, w: F.concat(F.substring(w["others"], F.lit(1), w["at"] * HEX), node, F.substring(w["others"], w["at"] * HEX + 1, F.length(w["others"])))
    return F.aggregate(witness, leaf, lambda node, w: F.sha2(put(node, w).cast("binary"), 256))


def witness_digest(witness: Column) -> Column:
    """Digest of all siblings of a witness, level by level."""
    return F.sha2(F.array_join(F.transform(witness, lambda w: w["others"]), "").cast("binary"), 256)
