"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius by BK-trees.

Equal fingerprints are one point. Points are dealt to shards so that any two within the radius meet
in at least one: the bits are cut into ``radius + 2`` blocks, two points that differ in at most
``radius`` bits agree on two whole blocks, and a shard is the set of points with given values in a
given pair of blocks. Each shard's points go one by one into a BK-tree, whose edges carry the exact
distance to the parent, and a search follows only the edges within the radius of its distance; once
a point has been linked, subtrees that lie in its component already are passed over. A shard gives
only the edges of a spanning forest. A shard that is too large is cut into slices, and each pair
of slices builds its own tree. Components come from the edges of all shards.

Edge cases: a null text or one without words has fingerprint zero, linked like any other; a text
with fewer words than a shingle is one shingle; repeated rows and equal texts share a fingerprint;
a null id never names a component unless all its ids are null; an empty table gives an empty
result; other columns play no part, but to choose among rows of equal id and text.

Similar texts (``one_per_group`` with a least ``jaccard``): there a point is a text by its words.
Texts whose fingerprints the trees link are checked, and as two texts whose word shingles agree to
0.8 differ in about 10 of 64 bits, all others are found by the prefix filter of ``prefix``,
which misses none. Only edges whose exact Jaccard similarity is enough link.

Trees stay where their shard's rows were shuffled to: a broadcast of them would take all
fingerprints through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.llm.common import cut, free_name
from waymark.llm.components import components
from waymark.llm.prefix import similar_sets

WORDS = 4
RADIUS = 4
SEED = 42
SLICE = 2048
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
AT_ONCE = 1 << 15


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    found = (text or "").encode().translate(LOWER).split()  # bytes.split() parts at ASCII white space
    if not found:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in found), dtype=np.int64, count=len(found))) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(words, len(found)) - 1:].tolist())
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), dtype=np.uint64, count=n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as an unsigned number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        part = hashes[at:at + AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(words: int = WORDS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            prints = np.fromiter((fingerprint(shingle_hashes(t, words)) for t in texts), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], [*batch.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed number."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string")).mapInArrow(_fingerprints(), "doc_id long, fp long")


def _blocks(n: int) -> list[tuple[int, int]]:
    """(shift, width) of the blocks."""
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    shifts = [sum(widths[:i]) for i in range(n)]
    return list(zip(shifts, widths))


def sharded(points: DataFrame, radius: int = RADIUS, slice_: int = SLICE) -> DataFrame:
    """(shard, part, *points): every point in each of its shards; large shards as pairs of slices."""
    value = lambda b: F.shiftrightunsigned("fp", b[0]).bitwiseAND(F.lit((1 << b[1]) - 1))
    keys = [
        F.lit(k << 40) + F.shiftleft(value(a), b[1]) + value(b) for k, (a, b) in enumerate(combinations(_blocks(radius + 2), 2))
    ]
    placed = points.select(*points.columns, F.explode(F.array(*keys)).alias("shard"))
    large = placed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > slice_).select("shard", F.ceil(F.col("n") / slice_).alias("slices"))
    mine = F.pmod(F.xxhash64(*points.columns), F.col("slices"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda j: F.least(mine, j) * F.col("slices") + F.greatest(mine, j))
    return placed.join(large, "shard", "left").select(
        "shard", F.explode(F.when(F.col("slices").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(pairs)).alias("part"), *points.columns
    )


class Tree:
    """BK-tree over the points of one shard, with the components found so far."""

    def __init__(self, radius: int = RADIUS):
        self.radius = radius
        self.points: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []  # of the union-find forest
        self.one: list[int] = []  # a point of the component that holds the whole subtree, or -1
        self.checked = 64

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, x: int) -> None:
        """Links ``x`` to every component within the radius, then hangs it in."""
        me, r = len(self.points), self.radius
        self.points.append(x)
        self.children.append({})
        self.parent.append(me)
        self.one.append(me)
        if me == 0:
            return
        stack = [0]
        while stack:
            node = stack.pop()
            if self.one[node] >= 0 and self.find(self.one[node]) == self.find(me):
                continue
            d = (x ^ self.points[node]).bit_count()
            if d <= r:
                self.parent[self.find(me)] = self.find(node)
            stack.extend(child for edge, child in self.children[node].items() if d - r <= edge <= d + r)
        node, root = 0, self.find(me)
        while True:
            if self.one[node] >= 0 and self.find(self.one[node]) != root:
                self.one[node] = -1
            d = (x ^ self.points[node]).bit_count()
            nxt = self.children[node].get(d)
            if nxt is None:
                self.children[node][d] = me
                break
            node = nxt
        if me >= self.checked:  # components have grown together since: look again which subtrees lie in one
            self.checked *= 2
            for node in range(me, -1, -1):
                mine = self.find(node)
                self.one[node] = node if all(self.one[c] >= 0 and self.find(self.one[c]) == mine for c in self.children[node].values()) else -1


def forest(points: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges from points to the first point of their component within one shard."""
    tree = Tree(radius)
    for x in points:
        tree.add(x)
    return [(points[i], points[r]) for i in range(len(points)) if (r := tree.find(i)) != i]


def _linking(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard and part; a run of equal keys is a shard."""
        held = None

        def links(shard: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0)) + 1
            starts, ends = np.concatenate(([0], new)), np.concatenate((new, [len(fp)]))
            points = fp.view(np.uint64)
            two = starts[ends - starts == 2]  # a tree of a root and a child: one distance
            near = two[np.bitwise_count(points[two] ^ points[two + 1]) <= radius]
            us, vs = [points[near + 1]], [points[near]]
            for a, b in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
                found = forest(points[a:b].tolist(), radius)
                if found:
                    u, v = zip(*found)
                    us.append(np.asarray(u, dtype=np.uint64))
                    vs.append(np.asarray(v, dtype=np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in (us, vs)], ["u", "v"])

        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(3)]
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns)]
            shard, part, _ = columns
            if not len(shard):
                continue
            last = int(np.flatnonzero((shard != shard[-1]) | (part != part[-1])).max(initial=-1)) + 1
            if last:
                yield links(*[c[:last] for c in columns])
            held = [c[last:] for c in columns]
        if held is not None:
            yield links(*held)

    return run


def linked(points: DataFrame, radius: int = RADIUS, slice_: int = SLICE) -> DataFrame:
    """(u, v): spanning edges between distinct fingerprints within the radius."""
    rows = sharded(points, radius, slice_)
    keyed = rows.repartition("shard", "part").sortWithinPartitions("shard", "part", "fp")
    return keyed.select("shard", "part", "fp").mapInArrow(_linking(radius), "u long, v long").distinct()


def _rooted(points: DataFrame, radius: int) -> DataFrame:
    """(fp, least, root) of distinct (fp, least) points."""
    hung = components(linked(points.select("fp"), radius))
    return points.join(hung, points["fp"] == hung["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    prints = cut(fingerprints(docs, doc_id, text), "prints")
    rooted = _rooted(cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points"), radius)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def _text_points(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            prints = np.fromiter((fingerprint(shingle_hashes(t, words)) for t in texts), dtype=np.uint64, count=batch.num_rows)
            nodes = pa.array([text_node(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], nodes, pa.array(prints.view(np.int64))], ["doc_id", "ref", "node", "fp"])

    return run


def text_node(text: str | None) -> int:
    """The text by its words, as a signed number."""
    value = xxhash.xxh64_intdigest(b" ".join((text or "").encode().translate(LOWER).split()), SEED)
    return value - (value >> 63 << 64)


def _shingle_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                texts = batch.column(0).slice(at, 100).to_pylist()
                sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in texts]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                nodes = pa.array([text_node(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([nodes, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["node", "shingles"])

    return run


def near_prints(points: DataFrame, radius: int) -> DataFrame:
    """(u, v): nodes of (node, fp) points whose fingerprints are equal or linked, as pairs with one node of a fingerprint."""
    named = cut(points.groupBy("fp").agg(F.min("node").alias("first")), "named")
    equal = points.join(named, "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    end = lambda fp, node: named.select(F.col("fp").alias(fp), F.col("first").alias(node))
    links = linked(named.select("fp"), radius).select(F.col("u").alias("a"), F.col("v").alias("b")).join(end("a", "u"), "a").join(end("b", "v"), "b")
    return equal.unionByName(links.select("u", "v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def similar(points: DataFrame, texts: DataFrame, words: int, jaccard: float, radius: int = RADIUS) -> DataFrame:
    """(u, v): edges that join all (node, ref, fp) points whose texts (ref, text) share ``jaccard`` of their shingles."""
    hashed = lambda of: of.select("text").mapInArrow(_shingle_sets(words), "node long, shingles array<long>")

    def sets_of(nodes: DataFrame) -> DataFrame:
        asked = points.join(nodes, "node").select("ref")
        return hashed(texts.join(asked, "ref").dropDuplicates(["ref"]))

    return similar_sets(hashed(texts), sets_of, jaccard, near_prints(points.select("node", "fp"), radius))


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = WORDS, jaccard: float | None = None) -> DataFrame:
    """One row of each group, that of the smallest id, with all its columns.

    Rows are told apart by a hash of id and text, so a group keeps a row of its own also where ids
    are null or serve several texts; of rows that agree in both, one stays. With ``jaccard``, texts are linked that share at least that
    part of their shingles, and ``radius`` only bounds what the trees propose.
    """
    mine, kept_ref, n = (free_name(docs, c) for c in ("_mine", "_kept", "_nth"))
    ref, own = F.xxhash64(f"`{doc_id}`", f"`{text}`"), [F.col(f"`{c}`") for c in docs.columns]
    read = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), ref.alias("ref"), F.col(f"`{text}`").cast("string"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "ref"))
    if jaccard is None:
        prints = read.mapInArrow(_fingerprints(words), "doc_id long, ref long, fp long")
        rooted = _rooted(cut(prints.groupBy("fp").agg(least.alias("least")), "points"), radius)
    else:
        prints = read.mapInArrow(_text_points(words), "doc_id long, ref long, node long, fp long")
        points = cut(prints.groupBy("node", "fp").agg(least.alias("least")), "points")
        texts = docs.select(ref.alias("ref"), F.col(f"`{text}`").cast("string").alias("text"))
        hung = components(similar(points.select("node", F.col("least.ref").alias("ref"), "fp"), texts, words, jaccard, radius))
        rooted = points.join(hung, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.ref").alias(kept_ref))
    rest = F.xxhash64(*[f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    nth = F.row_number().over(W.partitionBy(mine).orderBy(rest))
    rows = docs.select(*own, ref.alias(mine))
    return rows.join(kept, F.col(mine) == F.col(kept_ref)).withColumn(n, nth).where(F.col(n) == 1).select(*own)
