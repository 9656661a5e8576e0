"""Queries: data contracts and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import constants as K, geo, text
from waymark.operators import contracts as C
from waymark.operators import shaping as S
from waymark.plans.registry import query
from waymark.plans.shaping import DEMO_DOMAINS, HOST, schedule_rows
from waymark.plans.view_sql import hav, sql_list
from waymark.sources import catalogue, views as V
from waymark.sources.tables import table

CROWD, ACCESS, CONFIDENCE = ["low", "medium", "high", "very_high"], ["yes", "partial", "no", "unknown"], ["high", "medium", "low"]
TYPES = ["official", "government", "encyclopedic", "openstreetmap", "editorial"]


def place_rules():
    return [
        C.required("place"), C.typed("place", "bigint"), C.length("name", 2, 200), C.matches("name", "^[a-z]+ [a-z]+$"), C.within("lat", *K.LAT_RANGE), C.within("lon", *K.LON_RANGE),
        C.within("typ", 10, 200), C.within("min_dur", 5, 600), C.within("max_dur", 10, 900), C.one_of("kind", ["indoor", "outdoor", "mixed"]), C.within("sens", 0.0, 1.0),
        C.one_of("crowd", CROWD), C.one_of("access", ACCESS), C.within("senior", 1, 5), C.within("intensity", 1, 4), C.within("quality", 0.0, 0.95), C.one_of("confidence", CONFIDENCE),
        C.required("verified_on"),
    ]


PLACE_SQL = {
    "place_not_null": "place IS NULL", "place_type": "try_cast(CAST(place AS VARCHAR) AS BIGINT) IS NULL", "name_length": "length(name) NOT BETWEEN 2 AND 200", "name_pattern": "NOT regexp_matches(name, '^[a-z]+ [a-z]+$')",
    "lat_range": "lat NOT BETWEEN 6.5 AND 37.5", "lon_range": "lon NOT BETWEEN 68 AND 97.5", "typ_range": "typ NOT BETWEEN 10 AND 200", "min_dur_range": "min_dur NOT BETWEEN 5 AND 600", "max_dur_range": "max_dur NOT BETWEEN 10 AND 900",
    "kind_allowed": "kind NOT IN ('indoor', 'outdoor', 'mixed')", "sens_range": "sens NOT BETWEEN 0 AND 1", "crowd_allowed": f"NOT list_contains({sql_list(CROWD)}, crowd)", "access_allowed": f"NOT list_contains({sql_list(ACCESS)}, access)",
    "senior_range": "senior NOT BETWEEN 1 AND 5", "intensity_range": "intensity NOT BETWEEN 1 AND 4", "quality_range": "quality NOT BETWEEN 0 AND 0.95", "confidence_allowed": f"NOT list_contains({sql_list(CONFIDENCE)}, confidence)", "verified_on_not_null": "verified_on IS NULL",
}
SOURCE_SQL = {"url_prefix": "NOT starts_with(url, 'https://')", "source_type_allowed": f"NOT list_contains({sql_list(TYPES)}, source_type)", "place_not_null": "place IS NULL"}
SCHED_SQL = {"dow_range": "dow NOT BETWEEN -1 AND 6", "opens_range": "opens NOT BETWEEN 0 AND 1440", "closes_range": "closes NOT BETWEEN 0 AND 1560"}


def rules_sql(dataset, view, rules):
    return " UNION ALL ".join(f"SELECT '{dataset}' AS dataset, count(*) AS rows, '{n}' AS rule, 'error' AS severity, count(*) FILTER ({w}) AS failures FROM {view}" for n, w in rules.items())


@query("Q1_contract_engine", " UNION ALL ".join([rules_sql("places", "v_places", PLACE_SQL), rules_sql("sources", "v_sources", SOURCE_SQL), rules_sql("schedules", "v_sched", SCHED_SQL)]))
def q1(spark, root):
    places = V.places(spark, root)
    return (
        C.check(places, place_rules(), "places")
        .unionByName(C.check(V.sources(spark, root), [C.starts("url", "https://"), C.one_of("source_type", TYPES), C.required("place")], "sources"))
        .unionByName(C.check(schedule_rows(places), [C.within("dow", -1, 6), C.within("opens", 0, 1440), C.within("closes", 0, 1560)], "schedules"))
    )


@query("Q1_failing_rows", " UNION ALL ".join(f"SELECT place, '{n}' AS rule FROM v_places WHERE {w}" for n, w in PLACE_SQL.items()))
def q1b(spark, root):
    return C.failing_rows(V.places(spark, root), place_rules(), "place")


@query("Q2_cross_column_rules", """
  SELECT 'places' AS dataset, count(*) AS rows, 'duration_order' AS rule, 'error' AS severity, count(*) FILTER (NOT coalesce(raw_min <= typ AND typ <= raw_max, false)) AS failures FROM v_places
  UNION ALL SELECT 'schedules', count(*), 'open_needs_time', 'error', count(*) FILTER (NOT (is_closed OR opens IS NOT NULL)) FROM v_sched
  UNION ALL SELECT 'fees', count(*), 'fee_order', 'error', count(*) FILTER (NOT coalesce(raw_fee_max >= raw_fee_min, false)) FROM v_places
  UNION ALL SELECT 'activities', count(*), 'time_order', 'error', count(*) FILTER (end_min <= start_min) FROM v_acts""")
def q2(spark, root):
    places = V.places(spark, root)
    c = F.col
    return (
        C.check(places, [C.Rule("duration_order", (c("raw_min") <= c("typ")) & (c("typ") <= c("raw_max")))], "places")
        .unionByName(C.check(schedule_rows(places), [C.Rule("open_needs_time", c("is_closed") | c("opens").isNotNull())], "schedules"))
        .unionByName(C.check(places, [C.Rule("fee_order", c("raw_fee_max") >= c("raw_fee_min"))], "fees"))
        .unionByName(C.check(V.activities(spark, root), [C.Rule("time_order", c("end_min") > c("start_min"))], "activities"))
    )


@query("Q3_uniqueness", """
  SELECT 'line' AS key, l_orderkey AS a, CAST(l_linenumber AS BIGINT) AS b, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT 'place', p_partkey, 0, count(*) FROM part GROUP BY ALL HAVING count(*) > 1""")
def q3(spark, root):
    lines = C.repeated(table(spark, root, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").cast("bigint").alias("b")), ["a", "b"])
    parts = C.repeated(table(spark, root, "part").select(F.col("p_partkey").alias("a"), F.lit(0).cast("bigint").alias("b")), ["a", "b"])
    return lines.select(F.lit("line").alias("key"), "a", "b", "n").unionByName(parts.select(F.lit("place").alias("key"), "a", "b", "n"))


@query("Q4_referential", """
  SELECT 'order_owner' AS ref, count(*) AS broken FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'line_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'point_session', count(*) FROM v_points WHERE session NOT IN (SELECT session FROM v_sessions)""")
def q4(spark, root):
    orders = table(spark, root, "orders")
    broken = lambda df, name: df.agg(F.lit(name).alias("ref"), F.count("*").alias("broken"))
    owner = orders.join(table(spark, root, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    line = table(spark, root, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    point = V.points(spark, root).join(V.sessions(spark, root), "session", "left_anti")
    return broken(owner, "order_owner").unionByName(broken(line, "line_order")).unionByName(broken(point, "point_session"))


def runtime_checks(spark, root):
    """(name, severity, passed, value): one small aggregate per table or relation."""
    places = V.places(spark, root)
    one = lambda df, *checks: df.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), ok.alias("passed"), v.cast("bigint").alias("value")) for n, s, ok, v in checks
    ])))
    cutoff = F.date_sub(F.lit("2024-10-01").cast("date"), K.STALE_DAYS)
    stats = places.agg(
        F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"), F.count_if(~geo.in_bounds(F.col("lat"), F.col("lon"))).alias("outside"),
        F.count_if(F.col("verified_on").isNull() | (F.col("verified_on") < cutoff)).alias("stale"), F.count_if((F.size("windows") == 0) & (F.size("closed_dow") == 0)).alias("unscheduled"),
        F.count_if(F.col("fee_max").isNull()).alias("unpriced"), F.count_if(~F.col("unverified")).alias("claimed"),
    )
    c = F.col
    first = one(stats, ("clusters_loaded", "error", c("clusters") >= 8, c("clusters")), ("places_loaded", "error", c("n") >= 100, c("n")),
                ("every_place_has_hours", "warning", c("unscheduled") == 0, c("unscheduled")), ("every_place_has_cost", "warning", c("unpriced") == 0, c("unpriced")),
                ("coordinates_in_bounds", "error", c("outside") == 0, c("outside")), ("source_freshness", "warning", c("stale") == 0, c("stale")),
                ("not_falsely_verified", "error", c("claimed") == 0, c("claimed")))
    count = lambda df: df.agg(F.count("*").alias("v"))
    sourced = one(count(places.join(V.sources(spark, root), "place", "left_anti")), ("every_place_has_source", "error", c("v") == 0, c("v")))
    docs = table(spark, root, "documents").select("doc_id")
    indexed = one(count(docs), ("chunks_indexed", "error", c("v") >= 300, c("v")))
    vectors = table(spark, root, "embeddings").select(c("vec_id").alias("doc_id"))
    embedded = one(count(docs.join(vectors, "doc_id", "left_anti")), ("all_chunks_embedded", "error", c("v") == 0, c("v")))
    run = table(spark, root, "events").agg(F.max("ts").alias("last")).select(F.timestamp_diff("HOUR", c("last"), F.lit("2024-01-31").cast("timestamp")).alias("v"))
    recent = one(run, ("pipeline_ran_recently", "warning", F.coalesce(c("v") < 48, F.lit(False)), c("v")))
    return first.unionByName(sourced).unionByName(indexed).unionByName(embedded).unionByName(recent)


CHECKS_SQL = """
  SELECT 'clusters_loaded' AS name, 'error' AS severity, count(DISTINCT cluster) >= 8 AS passed, count(DISTINCT cluster) AS value FROM v_places
  UNION ALL SELECT 'places_loaded', 'error', count(*) >= 100, count(*) FROM v_places
  UNION ALL SELECT 'every_place_has_hours', 'warning', count(*) = 0, count(*) FROM v_places WHERE place NOT IN (SELECT place FROM v_sched)
  UNION ALL SELECT 'every_place_has_cost', 'warning', count(*) = 0, count(*) FROM v_places WHERE fee_max IS NULL
  UNION ALL SELECT 'coordinates_in_bounds', 'error', count(*) = 0, count(*) FROM v_places WHERE lat < 6.5 OR lat > 37.5 OR lon < 68 OR lon > 97.5
  UNION ALL SELECT 'source_freshness', 'warning', count(*) = 0, count(*) FROM v_places WHERE verified_on IS NULL OR verified_on < DATE '2024-10-01' - 400
  UNION ALL SELECT 'not_falsely_verified', 'error', count(*) = 0, count(*) FROM v_places WHERE NOT unverified
  UNION ALL SELECT 'every_place_has_source', 'error', count(*) = 0, count(*) FROM v_places WHERE place NOT IN (SELECT place FROM v_sources)
  UNION ALL SELECT 'chunks_indexed', 'error', count(*) >= 300, count(*) FROM documents
  UNION ALL SELECT 'all_chunks_embedded', 'error', count(*) = 0, count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
  UNION ALL SELECT 'pipeline_ran_recently', 'warning', coalesce(CAST(floor(epoch(TIMESTAMP '2024-01-31' - max(ts)) / 3600) AS BIGINT) < 48, false), CAST(floor(epoch(TIMESTAMP '2024-01-31' - max(ts)) / 3600) AS BIGINT) FROM events"""


@query("Q5_runtime_checks", CHECKS_SQL)
def q5(spark, root):
    return runtime_checks(spark, root)


@query("Q6_gate_status", f"""
  WITH c AS ({CHECKS_SQL}) SELECT CASE WHEN count(*) FILTER (severity = 'error' AND NOT passed) > 0 THEN 'fail' WHEN count(*) FILTER (NOT passed) > 0 THEN 'warn' ELSE 'pass' END AS status,
    count(*) FILTER (passed) AS passed, count(*) AS total, count(*) FILTER (severity = 'error' AND NOT passed) AS errors, count(*) FILTER (severity = 'warning' AND NOT passed) AS warnings,
    string_agg(name, '|' ORDER BY name) FILTER (severity = 'error' AND NOT passed) AS failed FROM c""")
def q6(spark, root):
    bad = ~F.col("passed")
    errors, warnings = F.count_if(bad & (F.col("severity") == "error")), F.count_if(bad & (F.col("severity") == "warning"))
    names = F.array_sort(F.collect_list(F.when(bad & (F.col("severity") == "error"), F.col("name"))))
    return runtime_checks(spark, root).agg(
        F.when(errors > 0, "fail").when(warnings > 0, "warn").otherwise("pass").alias("status"), F.count_if("passed").alias("passed"), F.count("*").alias("total"),
        errors.alias("errors"), warnings.alias("warnings"), F.nullif(F.array_join(names, "|"), F.lit("")).alias("failed"),
    )


@query("Q7_row_accounting", f"""
  WITH p AS (SELECT page_id, {HOST} AS host FROM pages), x AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rn FROM p),
  t AS (SELECT *, CASE WHEN rn > 1 THEN 'duplicate_key' WHEN NOT (host = 'example.com' OR host LIKE '%.example.com' OR host = 'ththth.example.net' OR host LIKE '%.ththth.example.net') THEN 'source_not_allowed' END AS reason FROM x)
  SELECT 'bronze' AS layer, count(*) AS rows_in, count(*) AS rows_out, 0 AS duplicates, 0 AS not_allowed FROM pages
  UNION ALL SELECT 'silver', count(*), count(*) FILTER (reason IS NULL), count(*) FILTER (reason = 'duplicate_key'), count(*) FILTER (reason = 'source_not_allowed') FROM t""")
def q7(spark, root):
    pages = table(spark, root, "pages")
    landed = catalogue.land(pages, "page", F.expr("concat('page::', page_id)"))
    rows = pages.select("page_id", text.host(F.col("url")).alias("host"))
    tagged = S.split_rejects(rows, "host", "page_id", text.allowed_host(F.col("host"), DEMO_DOMAINS))
    reason = F.col("reason")
    bronze = landed.agg(F.lit("bronze").alias("layer"), F.count("*").alias("rows_out")).select("layer", F.lit(None).cast("bigint").alias("rows_in"), "rows_out", F.lit(0).alias("duplicates"), F.lit(0).alias("not_allowed"))
    bronze = bronze.withColumn("rows_in", pages.agg(F.count("*")).scalar())
    silver = tagged.agg(
        F.lit("silver").alias("layer"), F.count("*").alias("rows_in"), F.count_if(reason.isNull()).alias("rows_out"),
        F.count_if(reason == "duplicate_key").alias("duplicates"), F.count_if(reason == "source_not_allowed").alias("not_allowed"),
    )
    return bronze.unionByName(silver)


@query("Q8_dataset_tests", f"""
  SELECT 'places_per_circuit' AS test, count(*) AS broken FROM (SELECT circuit FROM v_places GROUP BY 1 HAVING count(*) NOT BETWEEN 12 AND 20)
  UNION ALL SELECT 'indoor_option', count(*) FROM (SELECT circuit FROM v_places GROUP BY 1 HAVING count(*) FILTER (kind IN ('indoor', 'mixed')) = 0)
  UNION ALL SELECT 'unique_keys', count(*) FROM (SELECT place FROM v_places GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'neighbours_resolve', count(*) FROM (SELECT place, unnest([place + 1, place + 2, place, place + 5000000, place + 16, place + 3]) AS n FROM v_places) WHERE n NOT IN (SELECT place FROM v_places)
  UNION ALL SELECT 'not_own_neighbour', count(*) FROM v_places
  UNION ALL SELECT 'shared_coordinate', count(*) FROM (SELECT circuit, round(lat, 4), round(lon, 4) FROM v_places GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'near_centre', count(*) FROM v_places p JOIN (SELECT circuit, avg(lat) AS clat, avg(lon) AS clon FROM v_places GROUP BY 1) c USING (circuit) WHERE {hav('clat', 'clon', 'lat', 'lon')} >= 220
  UNION ALL SELECT 'window_fits_visit', count(*) FROM v_places p JOIN (SELECT place, max(closes - opens) AS longest FROM v_sched WHERE NOT is_closed GROUP BY 1) s ON s.place = p.place WHERE longest < min_dur
  UNION ALL SELECT 'future_verification', count(*) FROM v_places WHERE verified_on > DATE '2025-01-01'""")
def q8(spark, root):
    p = V.places(spark, root)
    n = lambda df, name: df.agg(F.lit(name).alias("test"), F.count("*").alias("broken"))
    per_circuit = p.groupBy("circuit").agg(F.count("*").alias("n"), F.count_if(F.col("kind").isin("indoor", "mixed")).alias("indoor"), F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
    refs = p.select("place", F.explode("nearby").alias("ref"))
    far = p.join(per_circuit, "circuit").where(geo.haversine_km(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon")) >= 220)
    longest = F.array_max(F.transform("windows", lambda w: w["closes"] - w["opens"]))
    tests = [
        n(per_circuit.where("n not between 12 and 20"), "places_per_circuit"), n(per_circuit.where("indoor = 0"), "indoor_option"), n(C.repeated(p, ["place"]), "unique_keys"),
        n(refs.join(p.select(F.col("place").alias("ref")), "ref", "left_anti"), "neighbours_resolve"), n(p.where(F.array_contains("nearby", F.col("place"))), "not_own_neighbour"),
        n(C.repeated(p.select("circuit", F.round("lat", 4).alias("a"), F.round("lon", 4).alias("o")), ["circuit", "a", "o"]), "shared_coordinate"), n(far, "near_centre"),
        n(p.where(longest < F.col("min_dur")), "window_fits_visit"), n(p.where(F.col("verified_on") > F.lit("2025-01-01").cast("date")), "future_verification"),
    ]
    out = tests[0]
    for t in tests[1:]:
        out = out.unionByName(t)
    return out


Q9_RULES = {
    "activities": ("v_acts", {"day_window": "start_min >= 480 AND end_min <= 1140", "weather_range": "weather >= 0 AND weather <= 1", "travel_range": "travel_min >= 0 AND travel_min <= 40"}),
    "trips": ("v_trips", {"date_order": "end_date >= start_date", "traveller_range": "travellers >= 1 AND travellers <= 5", "budget_positive": "budget IS NULL OR budget >= 1000", "window_order": "day_end > day_start"}),
    "sessions": ("v_sessions", {"expiry_after_start": "session_expires > started"}),
}


@query("Q9_table_checks", " UNION ALL ".join(f"SELECT '{d}' AS dataset, count(*) AS rows, '{n}' AS rule, 'error' AS severity, count(*) FILTER (NOT coalesce({w}, false)) AS failures FROM {v}" for d, (v, rules) in Q9_RULES.items() for n, w in rules.items()))
def q9(spark, root):
    frames = {"activities": V.activities, "trips": V.trips, "sessions": V.sessions}
    out = None
    for dataset, (_, rules) in Q9_RULES.items():
        checked = C.check(frames[dataset](spark, root), [C.Rule(n, F.expr(w)) for n, w in rules.items()], dataset)
        out = checked if out is None else out.unionByName(checked)
    return out
