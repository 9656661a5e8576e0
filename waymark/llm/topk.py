"""Exact top-k search by distributed histogram selection.

Queries go out in blocks of bounded size. For a block, every task scores all its vectors; a pass
counts scores per query in equal bins of the range where the k-th best must lie, and each task
reports only its topmost bins down to its own k-th score, since the k-th of all can lie no lower.
Merged counts give the bin of the k-th score, the next pass splits that bin, until bins are one
score wide. A last pass keeps what lies above the k-th score and, of the ties, each task's k
smallest ids; those few rows are ordered by score and id.

Edge cases: vectors that are null or hold null or non-finite components take no part; vectors are
compared with queries of their own length only, a query without candidates has no rows; the rows of
a query's own id are never its candidates; repeated query rows are answered once each; an empty
table gives an empty result. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from waymark.llm.common import cut

BLOCK = 2048  # queries in a block
BINS = 1024
TILE = 2_000_000  # scores held at a time
EXACT = 1 << 53


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): components as floor(scale * x), for vectors whose components are all finite."""
    x = F.col(f"`{embedding}`")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    ok = x.isNotNull() & F.coalesce(finite, F.lit(False))
    return vectors.where(ok).select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v")
    )


def _rows(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and component matrix of a batch, by vector length."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    lists = batch.column(1)
    flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    lengths = np.diff(offsets)
    out = {}
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        out[int(d)] = (ids[at], flat[offsets[at][:, None] + np.arange(d)[None, :]].reshape(len(at), int(d)))
    return out


def inner(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating-point matrix products where those are exact."""
    q, r = (int(np.abs(m).max(initial=0)) for m in (queries, rows))
    if q * r * max(1, queries.shape[1]) < EXACT:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def _scored(batches: Iterator[pa.RecordBatch], block: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """(query numbers, candidate ids, scores, which are candidates) tile by tile."""
    for batch in batches:
        for d, (ids, m) in _rows(batch).items():
            if d not in block:
                continue
            numbers, own, qs = block[d]
            step = max(1, TILE // len(numbers))
            for at in range(0, len(ids), step):
                part = ids[at:at + step]
                yield numbers, part, inner(qs, m[at:at + step]), own[:, None] != part[None, :]


def _counting(shared, k: int):
    """A pass: each task's histogram per query, reported from the top down to its own k-th score."""

    def run(batches):
        block, low, width = shared.value
        seen = np.zeros((len(low), BINS + 1), dtype=np.int64)  # the last bin holds what lies above the range
        for numbers, _, scores, real in _scored(batches, block):
            bins = (scores - low[numbers][:, None]) // width[numbers][:, None]
            flat = numbers[:, None] * (BINS + 1) + np.minimum(bins, BINS)
            seen += np.bincount(flat[real & (bins >= 0)], minlength=seen.size).reshape(seen.shape)
        upto = np.cumsum(seen[:, ::-1], axis=1)[:, ::-1]
        q, b = np.nonzero((seen > 0) & (upto - seen < k))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(seen[q, b])], ["q", "bin", "n"])

    return run


def _selecting(shared, k: int):
    """The last pass: rows above the k-th score, and each task's k smallest ids at it."""

    def run(batches):
        block, kth, _ = shared.value
        ties: dict[int, list[int]] = {}
        for numbers, ids, scores, real in _scored(batches, block):
            t = kth[numbers][:, None]
            i, j = np.nonzero(real & (scores > t))
            yield pa.RecordBatch.from_arrays([pa.array(numbers[i]), pa.array(ids[j]), pa.array(scores[i, j])], ["q", "vec_id", "score"])
            equal = real & (scores == t)
            for i in np.flatnonzero(equal.any(axis=1)):
                q = int(numbers[i])
                ties[q] = sorted(ties.get(q, []) + np.sort(ids[equal[i]])[:k].tolist())[:k]
        rows = [(q, v, int(kth[q])) for q, vs in ties.items() for v in vs]
        columns = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["q", "vec_id", "score"])

    return run


def _block(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    by: dict[int, list[int]] = {}
    for n, r in enumerate(rows):
        by.setdefault(len(r["v"]), []).append(n)
    return {
        d: (np.asarray(ns), np.asarray([rows[n]["vec_id"] for n in ns], dtype=np.int64), np.asarray([rows[n]["v"] for n in ns], dtype=np.int64).reshape(len(ns), d))
        for d, ns in by.items()
    }


def _search_block(vectors: DataFrame, rows: list, k: int, largest: int) -> DataFrame:
    spark = vectors.sparkSession
    block = _block(rows)
    bound = np.asarray([sum(abs(x) for x in r["v"]) * largest for r in rows], dtype=np.float64)
    low = -bound.astype(np.int64) - 1
    width = np.maximum(1, -(-(2 * bound.astype(np.int64) + 3) // BINS))
    open_ = np.ones(len(rows), dtype=bool)  # queries whose k-th score is not yet known
    while open_.any():
        shared = spark.sparkContext.broadcast((block, low, width))
        counts = vectors.mapInArrow(_counting(shared, k), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(W.partitionBy("q").orderBy(F.desc("bin")))
        # the bin of the k-th best, or the lowest bin where fewer than k candidates exist
        reached = counts.select("q", "bin", upto.alias("c")).groupBy("q").agg(
            F.coalesce(F.max(F.when(F.col("c") >= k, F.col("bin"))), F.min("bin")).alias("at")
        ).collect()  # at most a block of rows
        shared.unpersist()
        found = {r["q"]: r["at"] for r in reached}
        for q in np.flatnonzero(open_).tolist():
            if q not in found:
                open_[q] = False  # it has no candidates
                continue
            low[q] += found[q] * width[q]
            open_[q] = width[q] > 1
            width[q] = -(-width[q] // BINS)
    shared = spark.sparkContext.broadcast((block, low, width))
    few = vectors.mapInArrow(_selecting(shared, k), "q long, vec_id long, score long")
    best = few.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, r["vec_id"]) for n, r in enumerate(rows)], "q long, query_id long")
    return cut(best.join(F.broadcast(names), "q").select("query_id", "rank", "vec_id", "score"), "top")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best for every row of ``vectors`` where ``is_query`` holds.

    Blocks of queries are read one after another; the driver holds one block.
    """
    spark = vectors.sparkSession
    stored = cut(quantised(vectors, vec_id, embedding), "vectors")
    largest = stored.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0
    asked = cut(stored.where(is_query).repartitionByRange(F.col("vec_id")).select("vec_id", "v", F.spark_partition_id().alias("p")), "queries")
    out, rows = None, []

    def flush():
        nonlocal out, rows
        part = _search_block(stored, rows, k, int(largest))
        out, rows = part if out is None else out.unionByName(part), []

    for row in asked.orderBy("vec_id").toLocalIterator():
        rows.append(row)
        if len(rows) == BLOCK:
            flush()
    if rows:
        flush()
    empty = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    return out if out is not None else spark.createDataFrame([], empty)
