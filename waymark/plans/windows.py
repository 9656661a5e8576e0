"""Queries: ordered-per-key logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import text
from waymark.operators import grouped
from waymark.plans.joins import live_points
from waymark.plans.registry import query
from waymark.plans.shaping import HOST
from waymark.plans.view_sql import VIEWS, rnd as r
from waymark.sources import views as V
from waymark.sources.tables import table

VIEWS["v_latest"] = "SELECT trip, member, point, lat, lon, ts FROM (SELECT *, row_number() OVER (PARTITION BY trip, member ORDER BY ts DESC, point DESC) AS rn FROM v_live_points) WHERE rn = 1"


def latest_positions(spark, root, as_of=V.AS_OF):
    """Most recent live point per member, by a partially aggregated ``max_by``."""
    rows = live_points(spark, root, as_of).select("trip", "member", "point", "lat", "lon", "ts")
    latest = F.max_by(F.struct("point", "lat", "lon", "ts"), F.struct("ts", "point")).alias("p")
    return rows.groupBy("trip", "member").agg(latest).select("trip", "member", "p.*")


@query("W1_latest_position", f"SELECT trip, member, point, {r('lat', 6)} AS lat, {r('lon', 6)} AS lon FROM v_latest")
def w1(spark, root):
    return latest_positions(spark, root).select("trip", "member", "point", F.round(F.col("lat") + 1e-9, 6).alias("lat"), F.round(F.col("lon") + 1e-9, 6).alias("lon"))


VIEWS["v_versions"] = """
  SELECT owner, trip, start_date, row_number() OVER (PARTITION BY owner ORDER BY start_date, trip) AS version, count(*) OVER (PARTITION BY owner) AS n, travellers, budget FROM v_trips"""


def versions(spark, root):
    """Trips of an owner numbered in date order; buckets are dates, so a busy owner is split."""
    t = V.trips(spark, root).select("owner", "trip", "start_date", "travellers", "budget")
    counts = t.groupBy("owner").agg(F.count("*").alias("n"))
    numbered = grouped.ranked(t, ["owner"], F.col("start_date"), [F.col("start_date"), F.col("trip")], "version")
    return numbered.join(counts, "owner")


@query("W2_version_numbers", "SELECT owner, trip, version, CASE WHEN version = n THEN 'active' ELSE 'superseded' END AS status, n + 1 AS next_version FROM v_versions")
def w2(spark, root):
    return versions(spark, root).select(
        "owner", "trip", "version", F.when(F.col("version") == F.col("n"), "active").otherwise("superseded").alias("status"), (F.col("n") + 1).alias("next_version")
    )


ORDER = "start_min, end_min, place, qty, price, kind, version, travel_min, travel_km, weather"
VIEWS["v_gaps"] = f"SELECT *, lag(end_min) OVER (PARTITION BY plan, day ORDER BY {ORDER}) AS prev_end FROM v_acts"


def with_previous(acts):
    """Each activity with the end of the one before it on its day."""
    # minutes fit 20 bits, so the end of the latest start is the low part of one maximum
    last_end = F.max(F.shiftleft(F.col("start_min").cast("bigint"), 20) + F.col("end_min")).bitwiseAND((1 << 20) - 1).cast("int")
    return grouped.previous(
        acts, ["plan", "day"], F.floor(F.col("start_min") / 60), ORDER.split(", "), {"prev_end": "end_min"}, {"prev_end": last_end}
    )


@query("W3_gap_and_overlap", "SELECT plan, day, place, start_min, end_min, start_min - prev_end AS gap, coalesce(start_min < prev_end, false) AS overlaps FROM v_gaps")
def w3(spark, root):
    gap = F.col("start_min") - F.col("prev_end")
    return with_previous(V.activities(spark, root)).select(
        "plan", "day", "place", "start_min", "end_min", gap.alias("gap"), F.coalesce(gap < 0, F.lit(False)).alias("overlaps")
    )


@query("W4_version_deltas", f"""
  SELECT owner, trip, version, travellers - lag(travellers) OVER w AS travellers_delta, {r('budget - lag(budget) OVER w', 2)} AS budget_delta
  FROM v_versions WINDOW w AS (PARTITION BY owner ORDER BY version)""")
def w4(spark, root):
    prior = grouped.previous(
        versions(spark, root), ["owner"], F.floor(F.col("version") / 64), ["version"], {"p_travellers": "travellers", "p_budget": "budget"}
    )
    return prior.select(
        "owner", "trip", "version", (F.col("travellers") - F.col("p_travellers")).alias("travellers_delta"),
        F.round(F.col("budget") - F.col("p_budget") + 1e-9, 2).alias("budget_delta"),
    )


@query("W7_last_calls", "SELECT service, call, rn FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts DESC, call DESC) AS rn FROM v_calls) WHERE rn <= 500")
def w7(spark, root):
    return grouped.top_n(V.calls(spark, root), ["service"], [F.desc("ts"), F.desc("call")], 500, "rn").select("service", "call", "rn")


@query("W9_first_occurrence", f"SELECT host, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM (SELECT *, {HOST} AS host FROM pages) GROUP BY host")
def w9(spark, root):
    rows = table(spark, root, "pages").select(text.host(F.col("url")).alias("host"), "page_id", "url")
    return grouped.first_by(rows, ["host"], F.col("page_id"))


@query("W10_duplicate_visits", """
  SELECT plan, place, first_day, day, count(*) AS flagged FROM (
    SELECT plan, place, day, first_value(day) OVER w AS first_day, row_number() OVER w AS rn FROM v_acts WHERE kind = 'visit'
    WINDOW w AS (PARTITION BY plan, place ORDER BY day, start_min)) WHERE rn > 1 GROUP BY ALL""")
def w10(spark, root):
    return duplicate_visits(V.activities(spark, root).where("kind = 'visit'"))


def duplicate_visits(visits):
    """Later visits to the same place in a plan, counted per day; counts replace a per-plan sort."""
    per_day = visits.groupBy("plan", "place", "day").agg(F.count("*").alias("n"))
    first = per_day.groupBy("plan", "place").agg(F.min("day").alias("first_day"), F.sum("n").alias("total"))
    flagged = per_day.join(first.where("total > 1"), ["plan", "place"])
    extra = F.when(F.col("day") == F.col("first_day"), F.col("n") - 1).otherwise(F.col("n"))
    return flagged.withColumn("flagged", extra).where("flagged > 0").select("plan", "place", "first_day", "day", "flagged")


@query("W11_running_clock", f"""
  SELECT plan, day, place, start_min, sum(end_min - start_min) OVER w AS used_min, sum(travel_min) OVER w AS travelled, sum(qty) OVER w AS spent
  FROM v_acts WINDOW w AS (PARTITION BY plan, day ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""".replace("SELECT plan, day, place, start_min, sum(end_min - start_min) OVER w AS used_min, sum(travel_min) OVER w AS travelled", "SELECT plan, day, place, start_min, CAST(sum(end_min - start_min) OVER w AS BIGINT) AS used_min, CAST(sum(travel_min) OVER w AS BIGINT) AS travelled"))
def w11(spark, root):
    out = grouped.running_sums(
        V.activities(spark, root), ["plan", "day"], F.floor(F.col("start_min") / 60), [F.col(c) for c in ORDER.split(", ")],
        {"used_min": F.col("end_min") - F.col("start_min"), "travelled": F.col("travel_min"), "spent": F.col("qty")},
    )
    return out.select("plan", "day", "place", "start_min", "used_min", "travelled", "spent")
