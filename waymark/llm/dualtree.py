"""Exact ranked lexical search by a dual tree over items and documents.

A document's coordinate for a term is the term's integer impact in it, an item's is the term's
weight times its repeats, and a score is their inner product. Both sides get a hierarchy whose
nodes hold the largest value of every coordinate below them, so the inner product of two nodes
bounds every pair under them. The two trees are walked together from their roots; a pair of nodes
whose bound is below the weakest k-th score among the node's items is dropped with all that is under
it. Ties are never dropped: a bound has to be lower, not equal.

1. Texts are cut into terms once and stored as (document, terms, counts). Corpus figures come from
   that table: documents, terms, and how many documents hold each term that an item asks for.
2. Items go out in blocks of bounded terms and number. For a block, a fixed share of the documents
   is searched first; the k-th score found there bounds the true k-th score from below.
3. Every document is then searched from those bounds on. A task builds a tree over each batch of
   its documents, by parting them on the coordinates that vary most, keeps the k best of every item,
   and returns them; those few rows are ordered by score and id.

Edge cases: null and empty texts have no terms and are never found, an item without a term that some
document holds has no rows; a row is a document, so repeated rows and ids are ranked each; a null
doc_id comes after all others among ties; repeated items are answered each under their id; very long
texts are taken whole; an empty table gives an empty result; other columns play no part. Scores must
fit 64 bits, and so must 75 times an item's document length times the number of documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.llm.common import cut
from waymark.session import work_path

TERM = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))  # other bytes part terms
ITEMS, VOCABULARY = 512, 4096  # of a block; a single longer item is a block of its own
CELLS = 4_000_000  # numbers of a batch of documents held at a time
LEAF, FAN = 16, 4
AXES = 48  # coordinates that a tree is parted on
SEED_PART = 16  # one document of so many is searched first
EXACT = 1 << 53
RESULT = "item_id long, rank int, doc_id long, score long"


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text bytes) to (id, n, terms, counts)."""
    for batch in batches:
        flat, counts, ends, lengths = [], [], [0], []
        for raw in batch.column(1).to_pylist():
            words = (raw or b"").translate(TERM).split()
            seen = Counter(words)
            flat.extend(seen.keys())
            counts.extend(seen.values())
            ends.append(len(flat))
            lengths.append(len(words))
        at = pa.array(ends, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(at, pa.array(flat, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))],
            ["id", "n", "terms", "counts"],
        )


def term_counts(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id, n, terms, counts): distinct terms of every whole text, and how often each occurs."""
    return rows.select(F.col(f"`{row_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(
        _terms, "id long, n long, terms array<string>, counts array<long>"
    )


def arranged(m: np.ndarray, leaf: int) -> np.ndarray:
    """Order of the rows in which runs of ``leaf`` are alike: parted at the mean of the coordinate of most variance."""
    if len(m) <= leaf:
        return np.arange(len(m))
    x = m.astype(np.float64)
    spread = np.einsum("ij,ij->j", x, x) / len(x) - (x.sum(axis=0) / len(x)) ** 2
    x = x[:, np.argsort(-spread, kind="stable")[:AXES]]
    todo, out = [np.arange(len(m))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        varied = x[rows].var(axis=0)
        axis = int(np.argmax(varied))
        if not varied[axis]:
            out.append(rows)
            continue
        value = x[rows, axis]
        low = (value <= value.mean()).sum()  # most coordinates are 0 in most rows, so a median would part nothing
        middle = min(max(leaf, round(low / leaf) * leaf), (len(rows) - 1) // leaf * leaf)
        rows = rows[np.argsort(value, kind="stable")]
        todo += [rows[middle:], rows[:middle]]  # the first part comes off the stack first
    return np.concatenate(out)


class Tree:
    """Rows in tree order, and per level (leaves first) the nodes' coordinate maxima and first rows."""

    def __init__(self, matrix: np.ndarray, leaf: int = LEAF):
        self.order = arranged(matrix, leaf)
        self.rows = matrix[self.order]
        starts = np.arange(0, len(matrix), leaf)
        self.ends = np.append(starts[1:], len(matrix))
        self.starts = starts
        self.levels = [np.maximum.reduceat(self.rows, starts, axis=0)]
        while len(self.levels[-1]) > 1:
            self.levels.append(np.maximum.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), FAN), axis=0))

    def __len__(self) -> int:
        return len(self.levels)


class Best:
    """The k best of every item so far: scores, and ids with the null ones last."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.copy()  # the weakest score that can still matter
        self.rows = [(np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))] * len(least)

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        s, z, i = (np.concatenate(pair) for pair in zip(self.rows[item], (scores, nameless, ids)))
        top = np.lexsort((i, z, -s))[: self.k]
        self.rows[item] = (s[top], z[top], i[top])
        if len(top) == self.k:
            self.least[item] = max(self.least[item], s[top[-1]])


def search_batch(items: Tree, docs: Tree, ids: np.ndarray, nameless: np.ndarray, best: Best) -> int:
    """Walks both trees, updates ``best``, and returns how many pairs of rows were scored.

    ``best`` is in the item tree's row order. A pair is kept if its bound reaches the weakest score
    that matters to one of the node's items, which is at least 1: a score of 0 is no find.
    """
    upper, lower = items.levels, docs.levels
    a, b = len(upper) - 1, len(lower) - 1
    weakest = [np.minimum.reduceat(best.least, items.starts)]
    while len(weakest) < len(upper):
        weakest.append(np.minimum.reduceat(weakest[-1], np.arange(0, len(weakest[-1]), FAN)))
    open_ = np.ones((1, 1), dtype=bool)
    while True:
        rows, columns = open_.any(axis=1), open_.any(axis=0)
        if not rows.any():
            return 0
        bounds = np.zeros(open_.shape, dtype=upper[a].dtype)
        bounds[np.ix_(rows, columns)] = upper[a][rows] @ lower[b][columns].T
        open_ &= bounds >= weakest[a][:, None]
        if a == 0 and b == 0:
            break
        if a:
            a -= 1
            open_ = np.repeat(open_, FAN, axis=0)[: len(upper[a])]
        if b:
            b -= 1
            open_ = np.repeat(open_, FAN, axis=1)[:, : len(lower[b])]
    scored, ids, nameless = 0, ids[docs.order], nameless[docs.order]
    for node in np.flatnonzero(open_.any(axis=1)):
        mine = slice(items.starts[node], items.ends[node])
        near = np.flatnonzero(open_[node])
        near = near[np.argsort(-bounds[node, near], kind="stable")]
        at = 0
        while at < len(near):
            some = near[at:at + (1 if at == 0 else 8)]
            some = some[bounds[node, some] >= best.least[mine].min()]  # bounds fall: none of the later ones reach it either
            if not len(some):
                break
            at += 1 if at == 0 else 8
            these = np.concatenate([np.arange(docs.starts[d], docs.ends[d]) for d in some])
            scores = items.rows[mine] @ docs.rows[these].T
            scored += scores.size
            for i in range(scores.shape[0]):
                item = items.starts[node] + i
                hit = np.flatnonzero(scores[i] >= best.least[item])
                if len(hit):
                    best.add(item, scores[i, hit].astype(np.int64), ids[these[hit]], nameless[these[hit]])
    return scored


def impacts(counts: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Integer impact of a term that occurs ``counts`` times in a document of ``n`` terms."""
    m = 25 + (75 * n * documents) // terms
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def _searching(shared, k: int):
    """Index rows to (q, doc_id, score): this task's best of every item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights, numbers, least, documents, terms = shared.value
        items = Tree(weights, leaf=8)
        best = Best(least[items.order], k)
        step = max(LEAF, CELLS // max(1, len(vocabulary)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists, counts = part.column(2), part.column(3).flatten().to_numpy()
                code = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy()
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())
                known = code >= 0
                row, code = row[known], code[known]
                live, row = np.unique(row, return_inverse=True)  # documents that share a term with the block
                if not len(live):
                    continue
                n = part.column(1).to_numpy()[live]
                matrix = np.zeros((len(live), len(vocabulary)), dtype=weights.dtype)
                matrix[row, code] = impacts(counts[known], n[row], documents, terms)
                ids = part.column(0)
                nameless = ids.is_null().to_numpy(zero_copy_only=False)[live]
                search_batch(items, Tree(matrix), pc.fill_null(ids, 0).to_numpy()[live], nameless, best)
        found = [(numbers[q], *row) for q, rows in zip(items.order, best.rows) for row in zip(*rows)]
        q, score, nameless, ids = list(zip(*found)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int64()), pa.array([None if z else i for z, i in zip(nameless, ids)], pa.int64()), pa.array(score, pa.int64())], ["q", "doc_id", "score"]
        )

    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(index: DataFrame, block: list, k: int, figures: tuple[int, int]) -> DataFrame:
    """(q, item_id, rank, doc_id, score) for a block of items held by the driver."""
    spark = index.sparkSession
    vocabulary = sorted({t["term"] for r in block for t in r["terms"]})
    code = {t: i for i, t in enumerate(vocabulary)}
    exact = all(sum(t["weight"] for t in r["terms"]) * 1_000_000 < EXACT for r in block)  # no impact is above 1,000,000
    weights = np.zeros((len(block), len(vocabulary)), dtype=np.float64 if exact else np.int64)
    for i, r in enumerate(block):
        for t in r["terms"]:
            weights[i, code[t["term"]]] = t["weight"]
    names, numbers = pa.array(vocabulary, pa.string()), np.asarray([r["q"] for r in block])
    schema = "q long, doc_id long, score long"
    least = np.ones(len(block), dtype=np.int64)
    first = spark.sparkContext.broadcast((names, weights, numbers, least, *figures))
    seeds = _best(index.where(F.pmod(F.xxhash64("id", "n"), F.lit(SEED_PART)) == 0).mapInArrow(_searching(first, k), schema), k)
    at = {int(q): i for i, q in enumerate(numbers)}
    for r in seeds.where(F.col("rank") == k).collect():  # at most a row an item
        least[at[r["q"]]] = max(1, r["score"])
    second = spark.sparkContext.broadcast((names, weights, numbers, least, *figures))
    found = _best(index.mapInArrow(_searching(second, k), schema), k)
    items = spark.createDataFrame([(r["q"], r["id"]) for r in block], "q long, item_id long")
    return found.join(F.broadcast(items), "q").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item, scores above 0.

    Blocks of items are read one after another, and the driver holds one block; each block's rows
    are written to one folder before the next block starts.
    """
    spark = docs.sparkSession
    index = cut(term_counts(docs, doc_id, text), "terms")
    asked = cut(term_counts(items, item_id, text).withColumn("q", F.monotonically_increasing_id()), "items")
    total = index.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    figures = (int(total[0]), int(total[1] or 0))
    wanted = asked.select("q", "id", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("q", "id", F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    held = index.select(F.explode("terms").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * figures[0] + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighted = wanted.join(held, "term").select("q", "id", F.struct("term", (F.col("n") * weight).alias("weight")).alias("t"))
    questions = cut(weighted.groupBy("q", "id").agg(F.collect_list("t").alias("terms")), "questions")
    path, block, seen, done = work_path(spark, "found"), [], set(), 0

    def flush() -> None:
        nonlocal block, seen, done
        _search_block(index, block, k, figures).write.parquet(f"{path}/block={done}")
        block, seen, done = [], set(), done + 1

    for row in questions.orderBy("q").toLocalIterator():
        terms = {t["term"] for t in row["terms"]}
        if block and (len(block) == ITEMS or len(seen | terms) > VOCABULARY):
            flush()
        block.append(row)
        seen |= terms
    if block:
        flush()
    if not done:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(*[f"{path}/block={i}" for i in range(done)])
