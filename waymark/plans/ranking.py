"""Queries: sorts, limits, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import constants as K, geo, text
from waymark.functions.stats import rnd
from waymark.operators import grouped
from waymark.plans.registry import query
from waymark.plans.shaping import trip_days, weather
from waymark.plans.view_sql import VIEWS, hav, rnd as r, toks
from waymark.sources import views as V
from waymark.sources.tables import table


@query("K2_most_recent", "SELECT event_id, event_type, epoch_us(ts) AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def k2(spark, root):
    return table(spark, root, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "event_type", F.unix_micros("ts").alias("at"))


@query("K3_poll_since", "SELECT event_id, epoch_us(ts) AS at FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 100")
def k3(spark, root):
    newest = table(spark, root, "events").where(F.col("ts") > F.lit("2024-01-15").cast("timestamp")).orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return newest.select("event_id", F.unix_micros("ts").alias("at")).orderBy("at", "event_id")


@query("K4_stored_scores", """
  SELECT cluster, place, rank, place IN (SELECT place FROM v_acts WHERE kind = 'visit') AS selected FROM (
    SELECT cluster, place, row_number() OVER (PARTITION BY cluster ORDER BY quality DESC, place) AS rank FROM v_places) WHERE rank <= 60""")
def k4(spark, root):
    top = grouped.top_n(V.places(spark, root).select("cluster", "place", "quality"), ["cluster"], [F.desc("quality"), F.col("place")], 60)
    chosen = V.activities(spark, root).where("kind = 'visit'").select("place").distinct().withColumn("hit", F.lit(True))
    return top.join(chosen, "place", "left").select("cluster", "place", "rank", F.coalesce("hit", F.lit(False)).alias("selected"))


COMPONENTS = {"quality": "quality", "family": "(senior + child) / 10e0", "calm": "1e0 - (intensity - 1) / 4e0", "sheltered": "1e0 - sens", "popular": "1e0 - popularity / 100e0"}


@query("K7_top_components", "SELECT place, string_agg(name || '=' || CAST(CAST(floor(v * 100 + 0.5e0) AS BIGINT) AS VARCHAR), ', ' ORDER BY v DESC, name) AS top FROM (SELECT place, name, v, row_number() OVER (PARTITION BY place ORDER BY v DESC, name) AS rn FROM ("
    + " UNION ALL ".join(f"SELECT place, '{n}' AS name, round({e} + 1e-9, 4) AS v FROM v_places" for n, e in COMPONENTS.items()) + ")) WHERE rn <= 3 GROUP BY place")
def k7(spark, root):
    entries = F.array(*[F.struct((-rnd(F.expr(e), 4)).alias("v"), F.lit(n).alias("name")) for n, e in COMPONENTS.items()])
    return V.places(spark, root).select("place", top_components(entries).alias("top"))


def top_components(entries, n=3):
    """Largest entries of a small array of (negated value, name), as text."""
    shown = lambda e: F.concat(e["name"], F.lit("="), F.floor(-e["v"] * 100 + 0.5).cast("string"))
    return F.array_join(F.transform(F.slice(F.array_sort(entries), 1, n), shown), ", ")


@query("K8_nearest_first_days", f"""
  SELECT plan, day, row_number() OVER (PARTITION BY plan ORDER BY km, day) AS position FROM (
    SELECT s.plan, s.day, round({hav('max(t.base_lat)', 'max(t.base_lon)', 'avg(s.lat)', 'avg(s.lon)')} + 1e-9, 6) AS km FROM v_stops s JOIN v_trips t ON t.trip = s.plan GROUP BY s.plan, s.day)""")
def k8(spark, root):
    from waymark.plans.shaping import stops

    groups = stops(spark, root).groupBy("plan", "day").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    base = V.trips(spark, root).select(F.col("trip").alias("plan"), "base_lat", "base_lon")
    km = rnd(geo.haversine_km(F.col("base_lat"), F.col("base_lon"), F.col("lat"), F.col("lon")), 6)
    # a plan has a handful of day groups, so its order is a sort of a small array
    days = groups.join(base, "plan").groupBy("plan").agg(F.array_sort(F.collect_list(F.struct(km.alias("km"), "day"))).alias("d"))
    return days.select("plan", F.posexplode("d").alias("pos", "g")).select("plan", "g.day", (F.col("pos") + 1).alias("position"))


VIEWS["v_groups"] = """
  SELECT t.trip, t.days, p.place, CAST(p.place % t.days AS INT) AS day, p.lat, p.lon, p.quality FROM v_trips t JOIN v_places p ON p.circuit = t.circuit"""


@query("K9_top_up", f"""
  WITH g AS (SELECT trip, day, count(*) AS n, avg(lat) AS clat, avg(lon) AS clon FROM v_groups GROUP BY ALL),
  x AS (SELECT g.trip, g.day, g.n, c.place, row_number() OVER (PARTITION BY g.trip, g.day ORDER BY c.quality DESC, c.place) AS rn
    FROM g JOIN v_groups c ON c.trip = g.trip AND c.day <> g.day AND g.n < 4 WHERE {hav('clat', 'clon', 'c.lat', 'c.lon')} <= 40)
  SELECT trip, day, place, rn FROM x WHERE rn <= 6 - n""")
def k9(spark, root):
    trips = V.trips(spark, root).select("trip", "days", "circuit")
    items = trips.join(V.places(spark, root).select("place", "circuit", "lat", "lon", "quality"), "circuit").withColumn("day", F.expr("cast(place % days as int)"))
    thin = items.groupBy("trip", "day").agg(F.count("*").alias("n"), F.avg("lat").alias("clat"), F.avg("lon").alias("clon")).where("n < 4")
    others = items.select("trip", F.col("day").alias("own_day"), "place", "lat", "lon", "quality")
    near = thin.join(others, "trip").where(
        (F.col("own_day") != F.col("day")) & (geo.haversine_km(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon")) <= K.TOP_UP_RADIUS_KM)
    )
    return grouped.top_n(near, ["trip", "day"], [F.desc("quality"), F.col("place")], 6, "rn").where("rn <= 6 - n").select("trip", "day", "place", "rn")


# ------------------------------------------------------------------ set operations
@query("U1_plan_diff", f"""
  WITH v AS (SELECT plan, place, version, min(day) AS day, sum(travel_km) AS km FROM v_acts GROUP BY ALL),
  d AS (SELECT coalesce(a.plan, b.plan) AS plan, a.place IS NULL AS added, b.place IS NULL AS removed, a.day <> b.day AS moved, coalesce(b.km, 0e0) - coalesce(a.km, 0e0) AS km
    FROM (SELECT * FROM v WHERE version = 1) a FULL OUTER JOIN (SELECT * FROM v WHERE version = 2) b ON a.plan = b.plan AND a.place = b.place),
  s AS (SELECT plan, count(*) FILTER (added) AS added, count(*) FILTER (removed) AS removed, count(*) FILTER (coalesce(moved, false)) AS moved, {r('sum(km)', 2)} AS km_delta FROM d GROUP BY plan)
  SELECT *, coalesce(nullif(array_to_string(list_filter([CASE WHEN added > 0 THEN 'added ' || added END, CASE WHEN removed > 0 THEN 'removed ' || removed END,
    CASE WHEN moved > 0 THEN 'moved ' || moved END, CASE WHEN abs(km_delta) >= 0.5e0 THEN CAST(CAST(floor(km_delta + 0.5e0) AS BIGINT) AS VARCHAR) || ' km travel' END], lambda x: x IS NOT NULL), '; '), ''), 'no material change') AS summary FROM s""")
def u1(spark, root):
    side = lambda v, name: V.activities(spark, root).where(F.col("version") == v).groupBy("plan", "place").agg(
        F.min("day").alias(f"{name}_day"), F.sum("travel_km").alias(f"{name}_km")
    )
    joined = side(1, "a").join(side(2, "b"), ["plan", "place"], "full_outer")
    s = joined.groupBy("plan").agg(
        F.count_if(F.col("a_day").isNull()).alias("added"), F.count_if(F.col("b_day").isNull()).alias("removed"),
        F.count_if(F.col("a_day") != F.col("b_day")).alias("moved"),
        rnd(F.sum(F.coalesce("b_km", F.lit(0.0)) - F.coalesce("a_km", F.lit(0.0))), 2).alias("km_delta"),
    )
    n = lambda label: (F.col(label) > 0, F.concat(F.lit(f"{label} "), F.col(label).cast("string")))
    km = (F.abs("km_delta") >= 0.5, F.concat(F.floor(F.col("km_delta") + 0.5).cast("string"), F.lit(" km travel")))
    joined_text = F.array_join(text.message_list([n("added"), n("removed"), n("moved"), km]), "; ")
    return s.withColumn("summary", F.when(joined_text == "", "no material change").otherwise(joined_text))


@query("U2_missing_mandatory", "SELECT DISTINCT m.trip, m.place FROM (SELECT trip, unnest(must_places) AS place FROM v_members) m WHERE NOT EXISTS (SELECT 1 FROM v_acts a WHERE a.plan = m.trip AND a.place = m.place AND a.kind = 'visit')")
def u2(spark, root):
    visits = V.activities(spark, root).where("kind = 'visit'").select(F.col("plan").alias("trip"), "place")
    required = V.members(spark, root).select("trip", F.explode("must_places").alias("place")).distinct()
    return required.join(visits, ["trip", "place"], "left_anti")


@query("U3_token_overlap", f"""
  WITH t AS (SELECT conv_id, turn, list_distinct({toks('text')}) AS w FROM conversations)
  SELECT a.conv_id, a.turn, {r('len(list_intersect(a.w, b.w)) / CAST(nullif(len(a.w), 0) AS DOUBLE)', 4)} AS share FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def u3(spark, root):
    t = table(spark, root, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("w"))
    following = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("next_w"))
    return t.join(following, ["conv_id", "turn"]).select("conv_id", "turn", rnd(text.overlap(F.col("w"), F.col("next_w")), 4).alias("share"))


@query("U4_merged_wish_lists", """
  SELECT t.trip, coalesce(string_agg(DISTINCT CAST(w.place AS VARCHAR), '|' ORDER BY CAST(w.place AS VARCHAR)), '') AS must FROM v_trips t
  LEFT JOIN (SELECT trip, unnest(must_places) AS place FROM v_members UNION ALL SELECT trip, unnest(must_own) FROM v_trips) w ON w.trip = t.trip GROUP BY t.trip""")
def u4(spark, root):
    trips = V.trips(spark, root).select("trip", "must_own")
    wished = V.members(spark, root).groupBy("trip").agg(F.flatten(F.collect_list("must_places")).alias("theirs"))
    both = F.array_union("must_own", F.coalesce("theirs", F.array().cast("array<bigint>")))
    return trips.join(wished, "trip", "left").select("trip", F.array_join(F.array_sort(F.transform(both, lambda p: p.cast("string"))), "|").alias("must"))


@query("U5_known_choices", """
  WITH w AS (SELECT member, pos, CAST((trip // 128) * 16 + (member * 5 + pos * 7) % 24 AS BIGINT) AS place, trip // 128 AS circuit FROM (SELECT *, unnest(range(0, 14)) AS pos FROM v_members)),
  k AS (SELECT w.*, row_number() OVER (PARTITION BY member ORDER BY pos) AS rn FROM w JOIN v_places p ON p.place = w.place AND p.circuit = w.circuit)
  SELECT member, string_agg(CAST(place AS VARCHAR), '|' ORDER BY pos) AS kept FROM k WHERE rn <= 10 GROUP BY member""")
def u5(spark, root):
    wish = "transform(sequence(0, 13), pos -> (trip div 128) * 16 + (member * 5 + pos * 7) % 24)"
    wished = V.members(spark, root).select("member", F.expr("trip div 128").alias("circuit"), F.posexplode(F.expr(wish)).alias("pos", "place"))
    known = wished.join(V.places(spark, root).select("circuit", "place"), ["circuit", "place"], "left_semi")
    kept = known.groupBy("member").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "place"))), 1, 10).alias("k"))
    return kept.select("member", F.array_join("k.place", "|").alias("kept"))


VIEWS["v_trip_months"] = "SELECT trip, list_distinct(list(CAST(month(date) AS BIGINT))) AS tm FROM v_trip_days GROUP BY trip"


@query("U6_month_overlap", f"SELECT t.trip, p.place, {r('len(list_intersect(tm, p.months)) / CAST(len(tm) AS DOUBLE)', 4)} AS ratio FROM v_trip_months t JOIN v_trips v ON v.trip = t.trip JOIN v_places p ON p.circuit = v.circuit")
def u6(spark, root):
    months = F.array_distinct(F.transform(F.sequence("start_date", "end_date"), lambda d: F.month(d)))
    trips = V.trips(spark, root).select("trip", "circuit", months.alias("tm"))
    shared = F.size(F.array_intersect("tm", "months")) / F.size("tm")
    return trips.join(V.places(spark, root).select("place", "circuit", "months"), "circuit").select("trip", "place", rnd(shared, 4).alias("ratio"))


@query("U7_fallback_past_horizon", """
  SELECT trip, day_index, t_max, 'forecast' AS provider FROM v_weather WHERE day_index < 2
  UNION ALL SELECT trip, day_index, 20e0 + month(date), 'seasonal' FROM v_trip_days WHERE day_index >= 2""")
def u7(spark, root):
    known = weather(spark, root).where("day_index < 2").select("trip", "day_index", "t_max", F.lit("forecast").alias("provider"))
    days = trip_days(V.trips(spark, root)).select("trip", "day_index", "date")
    beyond = days.join(known, ["trip", "day_index"], "left_anti").select(
        "trip", "day_index", (F.lit(20.0) + F.month("date")).alias("t_max"), F.lit("seasonal").alias("provider")
    )
    return known.unionByName(beyond)
