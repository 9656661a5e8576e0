"""Splits, classifiers, ranking metrics and bootstrap intervals on distributed rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions import constants as K
from waymark.functions.stats import rnd
from waymark.operators import grouped
from waymark.session import cut

FEATURES = [*K.SCORE_WEIGHTS, *K.SCORE_PENALTIES]
SCORE_STEPS = 256
SPLIT_SHIFT = 22  # leaves 10 bits of the draw: a label is ordered in 1024 parts


def split(rows: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Deterministic 75/25 split inside each label: every fourth row of a label, in order of a hash of the key."""
    draw = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    drawn = rows.withColumns({"_draw": draw, "_stratum": F.coalesce(F.col(label).cast("string"), F.lit(""))})
    ordered = grouped.ranked(drawn, ["_stratum"], F.shiftright("_draw", SPLIT_SHIFT), [F.col("_draw"), F.col(key)], "_rank")
    return ordered.withColumn("test", F.col("_rank") % 4 == 0).drop("_draw", "_stratum", "_rank")


def control_score(rows: DataFrame) -> DataFrame:
    """Weighted rule score of the features."""
    text = " + ".join(f"{w}D * {c}" for c, w in K.SCORE_WEIGHTS.items()) + "".join(f" - {w}D * {c}" for c, w in K.SCORE_PENALTIES.items())
    return rows.withColumn("score", rnd(F.expr(text), 6))


def ranking_metrics(scored: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Exact ROC-AUC and average precision per ``keys`` from (score, label), ties shared.

    Rows are first collapsed to distinct scores; sums over better scores are taken per slice of
    the score range, so neither a large test set nor one key ends in a single task.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    points = scored.groupBy(*keys, "score").agg(
        F.sum(F.when(F.col("label") == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("label") == 0, w).otherwise(0.0)).alias("neg")
    )
    bucket = F.floor(-F.col("score") * SCORE_STEPS)
    ran = grouped.running_sums(points, keys, bucket, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")})
    totals = points.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    # each tie group beats the negatives below it and shares those beside it
    wins = F.col("pos") * (F.col("all_neg") - F.col("fp")) + F.col("pos") * F.col("neg") / 2
    gained = F.col("pos") * F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    return ran.join(totals, keys).groupBy(*keys).agg(
        F.try_divide(F.sum(wins), F.max("all_pos") * F.max("all_neg")).alias("auc"), F.try_divide(F.sum(gained), F.max("all_pos")).alias("pr_auc")
    )


def probability_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    p, y = F.col("score"), F.col("label")
    return scored.groupBy(*keys).agg(
        rnd(F.avg((p - y) * (p - y)), 4).alias("brier"), rnd(F.avg(((p >= 0.5).cast("int") == y).cast("double")), 4).alias("accuracy")
    )


def learners(seed: int = 20240101, trees: int = 300, boosts: int = 250) -> dict[str, Pipeline]:
    vector = VectorAssembler(inputCols=FEATURES, outputCol="raw")
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    return {
        "logistic_regression": Pipeline(stages=[vector, scale, LogisticRegression(labelCol="label", maxIter=2000)]),
        "random_forest": Pipeline(stages=[vector, RandomForestClassifier(labelCol="label", featuresCol="raw", numTrees=trees, maxDepth=9, minInstancesPerNode=8, seed=seed)]),
        "gradient_boosting": Pipeline(stages=[vector, GBTClassifier(labelCol="label", featuresCol="raw", maxIter=boosts, maxDepth=3, stepSize=0.06, seed=seed)]),
    }


def predict(model, rows: DataFrame, name: str) -> DataFrame:
    out = model.transform(rows).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    return out.select(F.lit(name).alias("model"), "doc_id", "label", "score")


def _weighted_parts(resamples: int, at_once: int = 256):
    """Sorted cells of a score range to one row: weights drawn per resample and the range's own AUC numerators.

    Equal scores never lie in two ranges. A cell of n rows draws Poisson(n), the sum of n draws of mean 1,
    from a generator of its own, so both scores see the same resample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros = lambda: np.zeros(resamples)
        # per resample: negatives below the current score; positives, negatives and half of the positives' ties at it
        below, pos, num, tied_pos, tied_neg, low, score = zeros(), zeros(), zeros(), zeros(), zeros(), None, None
        for batch in batches:
            for value, label, n, seed in zip(*(batch.column(c).to_pylist() for c in ("score", "label", "n", "seed"))):
                if value != score:
                    num += tied_pos * (below + 0.5 * tied_neg)
                    below += tied_neg
                    tied_pos, tied_neg, score = zeros(), zeros(), value
                    low = value if low is None else low
                drawn = np.random.Generator(np.random.PCG64(seed & (1 << 63) - 1)).poisson(n, resamples)
                if label:
                    tied_pos += drawn
                    pos += drawn
                else:
                    tied_neg += drawn
        if low is None:
            return
        num += tied_pos * (below + 0.5 * tied_neg)
        yield pa.RecordBatch.from_pydict({"low": [low], "pos": [pos.tolist()], "neg": [(below + tied_neg).tolist()], "num": [num.tolist()]})

    return run


def _resampled_auc(cells: DataFrame, score: str, resamples: int) -> DataFrame:
    """(resample, auc) of one score: cells are dealt by ranges of it, and one row a range meets the others."""
    ordered = cells.select(F.col(score).cast("double").alias("score"), "label", "n", "seed").repartitionByRange("score").sortWithinPartitions("score")
    parts = ordered.mapInArrow(_weighted_parts(resamples), "low double, pos array<double>, neg array<double>, num array<double>")
    each = parts.select("low", F.posexplode(F.arrays_zip("pos", "neg", "num")).alias("resample", "w"))
    before = F.coalesce(F.sum("w.neg").over(W.partitionBy("resample").orderBy("low").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    summed = each.select("resample", "w", (F.col("w.num") + F.col("w.pos") * before).alias("num")).groupBy("resample").agg(
        F.sum("num").alias("num"), F.sum("w.pos").alias("pos"), F.sum("w.neg").alias("neg")
    )
    return summed.where("pos > 0 and neg > 0").select("resample", (F.col("num") / (F.col("pos") * F.col("neg"))).alias("auc"))


def bootstrap_gap(scored: DataFrame, resamples: int = 2000) -> DataFrame:
    """Percentile interval of AUC(challenger) - AUC(control) over Poisson resamples of the same rows.

    ``scored``: label, challenger, control. Rows with equal scores and label are one cell; what is
    shuffled are the cells, once a score, and one row for each range of scores, whatever the resamples.
    """
    seed = F.xxhash64("challenger", "control", "label")
    cells = cut(scored.groupBy("challenger", "control", "label").agg(F.count("*").alias("n")).withColumn("seed", seed), "cells")
    a, b = (_resampled_auc(cells, side, resamples).withColumnRenamed("auc", side) for side in ("challenger", "control"))
    gaps = a.join(b, "resample").select((F.col("challenger") - F.col("control")).alias("gap"))
    low, high = F.percentile("gap", F.lit(0.025)), F.percentile("gap", F.lit(0.975))
    return gaps.agg(
        rnd(F.avg("gap"), 4).alias("point_estimate"), rnd(low, 4).alias("ci_low"), rnd(high, 4).alias("ci_high"), F.count("*").alias("resamples"), ((low > 0) | (high < 0)).alias("significant")
    )
