"""Skew-safe helpers against plain windows, with one key holding most rows."""

from __future__ import annotations

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.operators import grouped
from waymark.plans import joins


def skewed(spark, n=600):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(6)}", rng.randrange(400), i, rng.randrange(50)) for i in range(n)]
    return spark.createDataFrame(rows, "key string, t int, id int, v int")


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_ranked_equals_row_number(spark):
    df = skewed(spark)
    plain = df.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("t", "id")))
    mine = grouped.ranked(df, ["key"], F.floor(F.col("t") / 30), [F.col("t"), F.col("id")], "r")
    same(mine.select(plain.columns), plain)


def test_running_sums_equal_cumulative_window(spark):
    df = skewed(spark)
    frame = W.partitionBy("key").orderBy("t", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    plain = df.withColumn("s", F.sum("v").over(frame))
    mine = grouped.running_sums(df, ["key"], F.floor(F.col("t") / 30), [F.col("t"), F.col("id")], {"s": F.col("v")})
    same(mine.select(plain.columns), plain)


def test_previous_equals_lag_across_empty_buckets(spark):
    df = skewed(spark, 120)
    plain = df.withColumn("p", F.lag("v").over(W.partitionBy("key").orderBy("t", "id")))
    mine = grouped.previous(df, ["key"], F.floor(F.col("t") / 5), ["t", "id"], {"p": "v"})
    same(mine.select(plain.columns), plain)


def test_nest_splits_large_groups_and_loses_nothing(spark):
    df = spark.range(2500).selectExpr("if(id < 2400, 0, id) AS key", "id AS child")
    parts = grouped.nest(df, "key", F.struct("child"), F.col("child"), "children", part_size=100)
    sizes = parts.select("key", F.size("children").alias("n")).collect()
    assert sum(r["n"] for r in sizes) == 2500
    assert max(r["n"] for r in sizes) < 400


def test_first_by_takes_the_smallest_position(spark):
    df = spark.createDataFrame([("a", 3, "late"), ("a", 1, "first"), ("b", 2, "only")], "k string, pos int, v string")
    assert {(r["k"], r["v"]) for r in grouped.first_by(df, ["k"], F.col("pos")).collect()} == {("a", "first"), ("b", "only")}


def test_leg_matrix_has_more_parts_for_more_stops(spark, monkeypatch):
    """A task's share of the stops does not grow with the input, and the session keeps its settings."""
    from waymark import session

    monkeypatch.setattr(joins, "STOPS_AT_ONCE", 5)
    visits = spark.range(120).selectExpr("id div 4 as plan", "cast(id % 2 as int) as day", "id as place", "1e0 * id as lat", "2e0 as lon", "cast(id as int) as start_min")
    legs = joins.leg_matrix(visits, spark.range(30).selectExpr("id as plan", "'car' as mode"))
    assert legs.count() == 30 * 2 * 2
    assert legs._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(plan") == 2
    assert "hashpartitioning(plan" in (plan := legs._jdf.queryExecution().executedPlan().toString()) and ", 24), REPARTITION_BY_NUM" in plan
    assert spark.conf.get(session.PARTS, None) is None
    twice = joins.leg_matrix(visits, spark.range(60).selectExpr("id div 2 as plan", "'car' as mode"))
    assert twice.count() == 2 * 30 * 2 * 2


def test_leg_matrix_has_all_stops_of_a_day(spark):
    rows = [(1, 0, 10 * i, 12.0 + i / 100, 77.0, 540 + 30 * i) for i in range(13)] + [(2, 0, 1, 12.0, 77.0, 600), (2, 0, 2, 12.1, 77.0, None)]
    visits = spark.createDataFrame(rows, "plan long, day int, place long, lat double, lon double, start_min int")
    legs = joins.leg_matrix(visits, spark.createDataFrame([(1, "car"), (2, "car")], "plan long, mode string")).collect()
    assert sorted((r["plan"], r["i"], r["j"]) for r in legs) == sorted([(1, i, j) for i in range(13) for j in range(13) if i != j] + [(2, 0, 1), (2, 1, 0)])
    km = {(r["i"], r["j"]): r["km"] for r in legs if r["plan"] == 1}
    assert km[0, 12] == km[12, 0] > km[0, 11] > km[0, 9]


def test_assembly_keeps_one_row_of_a_place_with_many_children(spark):
    n = 2500
    places = spark.createDataFrame([(1,), (2,)], "place long")
    sched = spark.range(n).selectExpr("1L AS place", "cast(id % 7 AS int) AS dow", "cast(id AS int) AS opens", "cast(id + 60 AS int) AS closes", "false AS is_closed")
    fees = spark.createDataFrame([(1, "adult", 1.0, 2.0), (2, "adult", 1.0, 2.0)], "place long, visitor string, amount_min double, amount_max double")
    src = spark.range(n).selectExpr("id AS source", "1L AS place", "cast(id AS int) AS pos", "concat('u', id) AS url", "'blog' AS source_type", "array('history') AS covers")
    got = {r["place"]: r for r in joins.assembled(places, sched, fees, src).collect()}
    assert joins.assembled(places, sched, fees, src).count() == 2
    assert tuple(got[1])[1:4] == (n, 1, n) and got[1]["urls"] == "|".join(f"u{i}" for i in range(n))
    assert tuple(got[2]) == (2, 0, 1, 0, "")
