"""Cluster metrics, spend accuracy, vote tallies and service health as DataFrame aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions.stats import rate, rnd
from waymark.operators import grouped


def cluster_metrics(places: DataFrame, key: str = "cluster") -> DataFrame:
    """Counts, shares and medians per cluster in one partially aggregated pass."""
    share = lambda c: rnd(F.avg(c.cast("double")), 4)
    return places.groupBy(key).agg(
        F.count("*").alias("n_places"),
        rnd(F.avg("quality"), 4).alias("mean_quality"),
        share(F.col("access").isin("yes", "partial")).alias("pct_accessible"),
        share(F.col("kind").isin("indoor", "mixed")).alias("pct_indoor"),
        F.median("typ").alias("median_minutes"),
        share(F.col("unverified")).alias("pct_unverified"),
        F.size(F.array_distinct(F.flatten(F.collect_set("tags")))).cast("bigint").alias("n_tags"),
        rnd(F.avg("senior"), 3).alias("mean_senior"),
        rnd(F.avg("child"), 3).alias("mean_child"),
    )


def spread(points: DataFrame, key: str) -> DataFrame:
    """Largest distance from the mean centre per key."""
    centre = points.groupBy(key).agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
    km = geo.haversine_km(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon"))
    return points.join(centre, key).groupBy(key).agg(rnd(F.max(km), 3).alias("spread_km"))


def spend_accuracy(rows: DataFrame) -> DataFrame:
    """Share inside the range and mean absolute error against the midpoint; no figure without rows."""
    mid = (F.col("low") + F.col("high")) / 2
    error = F.when(mid != 0, F.abs(F.col("actual") - mid) / mid)
    inside = F.col("actual").between(F.col("low"), F.col("high"))
    return rows.agg(
        F.count("*").alias("samples"),
        F.when(F.count("*") > 0, rate(F.count_if(inside), F.count("*"))).alias("within_range"),
        rnd(F.avg(error), 4).alias("mape"),
    )


def latest_votes(votes: DataFrame) -> DataFrame:
    """One vote per (trip, member, subject): the latest."""
    return votes.groupBy("trip", "member", "subject").agg(F.max_by("value", F.struct("ts", "vote")).alias("value"))


def tally(votes: DataFrame) -> DataFrame:
    return latest_votes(votes).groupBy("trip", "subject").agg(
        *[F.count_if(F.col("value") == v).alias(v) for v in ("up", "down", "abstain")]
    )


def service_health(calls: DataFrame, last: int = 500) -> DataFrame:
    """Per service over its last calls; percentiles are the element at floor(n p), 0-based."""
    recent = grouped.top_n(calls, ["service"], [F.desc("ts"), F.desc("call")], last)
    s = recent.groupBy("service").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors"), F.count_if("fallback").alias("fallbacks"),
        F.sort_array(F.collect_list("latency")).alias("sorted"), F.array_sort(F.collect_set("provider")).alias("providers"),
    )
    element = lambda p: F.element_at("sorted", F.least(F.col("calls") - 1, F.floor(F.col("calls") * p)).cast("int") + 1)
    return s.select(
        "service", "calls", rate(F.col("errors"), F.col("calls")).alias("error_rate"),
        rate(F.col("fallbacks"), F.col("calls")).alias("fallback_rate"), rnd(element(0.50), 2).alias("p50"),
        rnd(element(0.95), 2).alias("p95"), rnd(F.array_max("sorted"), 2).alias("max"),
        F.array_join("providers", "|").alias("providers"),
    )
