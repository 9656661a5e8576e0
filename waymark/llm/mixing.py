"""Mixing sources to target weights by pivotal dependent rounding.

A source's target, divided by its size, is the expected number of copies of each of its documents.
Whole copies are certain; the fractions are rounded in pairs: words move at random from one
document's fraction to another's until one of the two is integral, so that every fraction keeps
its expectation and the words of the pair stay the same. Within a shard of a source this leaves at
most one fraction; shards' residuals meet in a reduction tree with a fixed fan-in, and the last
residual of a source is drawn. A source therefore misses its target by less than one document.

Edge cases: a null text has no words; a document without words takes nothing; null is a source of
its own, last in order; equal ids and repeated rows are rounded one by one; an empty table gives an
empty result; other columns play no part. Draws depend on the seed and the rows only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.llm.common import cut, free_name, text_or_empty, word_count
from waymark.operators.grouped import ranked

ROW = "doc_id long, mark long, size long, source_size long, target double, src long, shard long, whole long, part double"


@dataclass(frozen=True)
class Mix:
    cycle: tuple[int, ...] = (1, 2, 3)  # weights of the sources in code-point order, repeated
    most: int = 3  # copies of a document, on average over a source
    seed: int = 20240607
    shard_docs: int = 2048
    fan_in: int = 64


def source_targets(sized: DataFrame, mix: Mix) -> DataFrame:
    """(source, src, docs, source_size, target): weights by order, shares of all words, capped and reshared.

    Order numbers come from range partitions and their row counts. Each round of resharing takes two
    sums to the driver; a source once at its cap stays there.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sums = sums.select("*", F.col("source").isNull().alias("last")).repartitionByRange("last", "source")
    sums = cut(sums.withColumn("pid", F.spark_partition_id()), "sources")
    order = [F.col("last"), F.col("source")]
    numbered = ranked(sums, [], F.col("pid"), order, "src").withColumn("src", F.col("src").cast("long"))
    weight = F.element_at(F.array(*[F.lit(w) for w in mix.cycle]), (F.pmod(F.col("src") - 1, F.lit(len(mix.cycle))) + 1).cast("int"))
    numbered = cut(numbered.select("source", "src", "docs", "source_size", weight.alias("weight"), (F.col("source_size") * mix.most).alias("cap")), "ranks")
    level, all_words = 0.0, int(numbered.agg(F.sum("source_size")).first()[0] or 0)
    while all_words:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        taken, free = numbered.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            break
        following = (all_words - int(taken or 0)) / int(free)
        if following <= level:
            break
        level = following
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level)))
    return numbered.select("source", "src", "docs", "source_size", target.alias("target"))


def transfer(p: float, w: int, q: float, v: int, u: float) -> tuple[float, float]:
    """Moves words between fractions p (of w words) and q (of v words) until one is 0 or 1."""
    to_p, to_q = min(w * (1.0 - p), v * q), min(w * p, v * (1.0 - q))
    if u * (to_p + to_q) < to_q:
        return (1.0, q - to_p / v) if w * (1.0 - p) < v * q else (p + to_p / w if w * (1.0 - p) > v * q else 1.0, 0.0)
    return (0.0, q + to_q / v) if w * p < v * (1.0 - q) else (p - to_q / w if w * p > v * (1.0 - q) else 0.0, 1.0)


def round_group(sizes: np.ndarray, parts: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Rounds the fractions of a group in order; at most one stays strictly between 0 and 1."""
    out, held = parts.tolist(), -1
    w = sizes.tolist()
    for i, u in enumerate(draws.tolist()):
        if not 0.0 < out[i] < 1.0:
            continue
        if held >= 0:
            a, b = transfer(out[held], w[held], out[i], w[i], u)
            out[held], out[i] = min(max(a, 0.0), 1.0), min(max(b, 0.0), 1.0)
            if 0.0 < out[held] < 1.0:
                continue
        held = i if 0.0 < out[i] < 1.0 else -1
    return np.asarray(out)


def _rounding(mix: Mix, level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mark", "doc_id", "size"], kind="stable")
        rng = np.random.Generator(np.random.PCG64([mix.seed, level, int(pdf["src"].iloc[0]), int(pdf["shard"].iloc[0])]))
        part = round_group(pdf["size"].to_numpy(), pdf["part"].to_numpy(), rng.random(len(pdf)))
        if last:
            part = np.where((part > 0.0) & (part < 1.0), (rng.random(len(part)) < part).astype(float), part)
        return pdf.assign(part=part)

    return run


def copies(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, source, size) rows with source_size, target and the number of copies taken."""
    sized = cut(sized.select("doc_id", "source", "size"), "sizes")
    targets = source_targets(sized, mix)
    most_docs = targets.agg(F.max("docs")).first()[0] or 0
    shards = max(1, math.ceil(most_docs / mix.shard_docs))
    t = targets.select(F.col("source").alias("_s"), "src", "docs", "source_size", "target")
    expected = F.least(F.lit(float(mix.most)), F.col("target") / F.col("source_size"))
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", F.xxhash64("doc_id", "size", F.lit(mix.seed)).alias("mark"), "size", "source_size", "target", "src",
        F.ceil(F.col("docs") / mix.shard_docs).alias("_of"), F.when(F.col("size") > 0, expected).otherwise(F.lit(0.0)).alias("_e"),
    ).select(
        "doc_id", "mark", "size", "source_size", "target", "src", F.pmod(F.col("mark"), F.col("_of")).alias("shard"),
        F.floor("_e").alias("whole"), (F.col("_e") - F.floor("_e")).alias("part"),
    )
    open_ = (F.col("part") > 0) & (F.col("part") < 1)
    settled, level = [], 0
    while True:
        done = cut(rows.groupBy("src", "shard").applyInPandas(_rounding(mix, level, shards == 1), ROW), "rounded")
        if shards == 1:
            settled.append(done)
            break
        settled.append(done.where(~open_))
        rows = done.where(open_).withColumn("shard", F.floor(F.col("shard") / mix.fan_in))
        shards, level = math.ceil(shards / mix.fan_in), level + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") + F.col("part").cast("long")).alias("copies"))


def document_sizes(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(text_or_empty(f"`{text}`")).alias("size"))


def mixed(docs: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The documents themselves, each as often as the mix takes it.

    Rows that share an id are matched to their copies by size and then in order of text.
    """
    took = copies(document_sizes(docs, text, source, doc_id), mix)
    id_, size, nth, times, my_id, my_size, my_nth = (free_name(docs, n) for n in ("_id", "_size", "_nth", "_copies", "_my_id", "_my_size", "_my_nth"))
    key = W.partitionBy(id_, size)
    right = took.where(F.col("copies") > 0).select(F.col("doc_id").alias(id_), F.col("size").alias(size), F.col("copies").alias(times)).withColumn(nth, F.row_number().over(key.orderBy(F.desc(times))))
    own = [F.col(f"`{c}`") for c in docs.columns]
    left = docs.select(*own, F.col(f"`{doc_id}`").cast("long").alias(my_id), word_count(text_or_empty(f"`{text}`")).alias(my_size))
    left = left.withColumn(my_nth, F.row_number().over(W.partitionBy(my_id, my_size).orderBy(F.xxhash64(f"`{text}`"))))
    j = left.join(right, F.col(my_id).eqNullSafe(F.col(id_)) & (F.col(my_size) == F.col(size)) & (F.col(my_nth) == F.col(nth)))
    return j.select(*own, F.explode(F.array_repeat(F.lit(True), F.col(times).cast("int"))).alias(free_name(docs, "_copy"))).select(*own)
