"""Queries: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import constants as K, geo
from waymark.functions.stats import rnd
from waymark.operators import grouped, shaping as S
from waymark.plans.registry import query
from waymark.plans.shaping import fee_rows, leg_sql, schedule_rows, trip_days
from waymark.plans.view_sql import VIEWS, rnd as r, sql_list
from waymark.session import cut_in_parts
from waymark.sources import views as V
from waymark.sources.tables import table

TODAY = "1998-06-01"
STOPS_AT_ONCE = 500_000  # stops of a part of the leg matrix, about


@query("J1_metrics_with_attributes", f"""
  SELECT m.cluster, m.n, m.mean_quality, n.n_name AS name, r.r_name AS region FROM
    (SELECT cluster, count(*) AS n, {r('avg(quality)', 4)} AS mean_quality FROM v_places GROUP BY cluster) m
  LEFT JOIN nation n ON n.n_nationkey = CAST(substr(m.cluster, 7) AS INT) LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def j1(spark, root):
    metrics = V.places(spark, root).groupBy("cluster").agg(F.count("*").alias("n"), rnd(F.avg("quality"), 4).alias("mean_quality"))
    attributes = table(spark, root, "nation").join(
        table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
    ).select(F.concat(F.lit("Brand#"), "n_nationkey").alias("cluster"), F.col("n_name").alias("name"), F.col("r_name").alias("region"))
    return metrics.join(attributes, "cluster", "left")


@query("J2_destinations_with_trip_counts", """
  SELECT n_name AS name, count(o_orderkey) AS trips FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey
  LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name""")
def j2(spark, root):
    per_owner = table(spark, root, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    owners = table(spark, root, "customer").select("c_custkey", "c_nationkey")
    per_nation = owners.join(per_owner, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.sum("n").alias("n"))
    return table(spark, root, "nation").join(per_nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("n_name").alias("name"), F.coalesce("n", F.lit(0)).alias("trips")
    )


@query("J3_outer_join_then_filter", """
  SELECT c_custkey AS owner, count(o_orderkey) AS trips FROM customer LEFT JOIN orders ON o_custkey = c_custkey
  WHERE o_orderstatus = 'O' GROUP BY c_custkey""")
def j3(spark, root):
    joined = table(spark, root, "customer").join(table(spark, root, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.where("o_orderstatus = 'O'").groupBy(F.col("c_custkey").alias("owner")).agg(F.count("o_orderkey").alias("trips"))


@query("J4_feedback_with_spend", """
  SELECT l_orderkey AS plan, l_extendedprice AS spend, o_totalprice AS total FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE nullif(l_discount, 0e0) IS NOT NULL""")
def j4(spark, root):
    feedback = table(spark, root, "lineitem").select("l_orderkey", "l_extendedprice", F.nullif("l_discount", F.lit(0.0)).alias("rated"))
    return feedback.where("rated is not null").join(table(spark, root, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("l_orderkey").alias("plan"), F.col("l_extendedprice").alias("spend"), F.col("o_totalprice").alias("total")
    )


@query("J5_missing_children", """
  SELECT 'place_without_source' AS issue, place AS id FROM v_places p WHERE NOT EXISTS (SELECT 1 FROM v_sources s WHERE s.place = p.place)
  UNION ALL SELECT 'place_without_visit', place FROM v_places p WHERE NOT EXISTS (SELECT 1 FROM v_acts a WHERE a.place = p.place)
  UNION ALL SELECT 'trip_without_plan', trip FROM v_trips t WHERE NOT EXISTS (SELECT 1 FROM v_acts a WHERE a.plan = t.trip)""")
def j5(spark, root):
    places, trips = V.places(spark, root).select("place"), V.trips(spark, root).select("trip")
    acts = V.activities(spark, root)
    anti = lambda left, right, on, name, column: left.join(right, on, "left_anti").select(F.lit(name).alias("issue"), F.col(column).alias("id"))
    return (
        anti(places, V.sources(spark, root), "place", "place_without_source", "place")
        .unionByName(anti(places, acts, "place", "place_without_visit", "place"))
        .unionByName(anti(trips, acts.withColumnRenamed("plan", "trip"), "trip", "trip_without_plan", "trip"))
    )


@query("J6_chunks_without_vector", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def j6(spark, root):
    vectors = table(spark, root, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, root, "documents").select("doc_id", "n_chars").join(vectors, "doc_id", "left_anti")


@query("J7_orphan_points", "SELECT point, session FROM v_points WHERE session NOT IN (SELECT session FROM v_sessions)")
def j7(spark, root):
    return V.points(spark, root).select("point", "session").join(V.sessions(spark, root), "session", "left_anti")


@query("J8_vectors_for_candidates", """
  SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) + 1e-9, 6) AS total
  FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)""")
def j8(spark, root):
    wanted = table(spark, root, "labels").select(F.col("doc_id").alias("vec_id"))
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return table(spark, root, "embeddings").join(wanted, "vec_id", "left_semi").select("vec_id", "label", rnd(total, 6).alias("total"))


VIEWS["v_live_points"] = f"""
  SELECT p.*, s.status, m.weight FROM v_points p JOIN v_sessions s ON s.session = p.session JOIN v_members m ON m.member = p.member
  WHERE p.expires > TIMESTAMP '{V.AS_OF}' AND s.status = 'active' AND s.session_expires > TIMESTAMP '{V.AS_OF}'"""


def live_points(spark, root, as_of=V.AS_OF):
    """Unexpired points of active sessions, with the member."""
    now = F.lit(as_of).cast("timestamp")
    p = V.points(spark, root).where(F.col("expires") > now)
    s = V.sessions(spark, root).where((F.col("status") == "active") & (F.col("session_expires") > now)).select("session", "status")
    return p.join(s, "session").join(V.members(spark, root).select("member", "weight"), "member")


@query("J9_live_points", "SELECT point, member, trip, weight FROM v_live_points")
def j9(spark, root):
    return live_points(spark, root).select("point", "member", "trip", "weight")


@query("J10_upcoming_circuits", f"SELECT DISTINCT circuit, centre_lat FROM v_trips WHERE end_date >= DATE '{TODAY}' AND start_date <= DATE '{TODAY}' + 10")
def j10(spark, root):
    today = F.lit(TODAY).cast("date")
    return V.trips(spark, root).where((F.col("end_date") >= today) & (F.col("start_date") <= F.date_add(today, 10))).select("circuit", "centre_lat").distinct()


@query("J11_resolve_neighbours", """
  WITH n AS (SELECT place, circuit, unnest(range(1, 6)) AS pos, unnest([place + 1, place + 2, place, place + 5000000, place + 16]) AS slug FROM v_places)
  SELECT n.place, CAST(n.pos - 1 AS INT) AS pos, n.slug AS neighbour, q.circuit = n.circuit AS same_circuit FROM n JOIN v_places q ON q.place = n.slug WHERE n.slug <> n.place""")
def j11(spark, root):
    places = V.places(spark, root).select("place", "circuit", "nearby")
    refs = places.select("place", "circuit", F.posexplode(F.slice("nearby", 1, 5)).alias("pos", "slug"))
    local = places.select("circuit", F.col("place").alias("slug"), F.col("place").alias("local_hit"))
    anywhere = places.groupBy(F.col("place").alias("slug")).agg(F.min("place").alias("any_hit"), F.min("circuit").alias("any_circuit"))
    found = refs.join(local, ["circuit", "slug"], "left").join(anywhere, "slug", "left")
    hit = F.coalesce("local_hit", "any_hit")
    return found.where(hit.isNotNull() & (hit != F.col("place"))).select(
        "place", "pos", hit.alias("neighbour"), (F.col("local_hit").isNotNull() | (F.col("any_circuit") == F.col("circuit"))).alias("same_circuit")
    )


NOW_MIN = 600


@query("J12_next_activity", f"""
  SELECT plan, strftime(date, '%Y-%m-%d') AS date, start_min, place FROM (
    SELECT *, row_number() OVER (PARTITION BY plan ORDER BY date, start_min, place) AS rn FROM v_stops
    WHERE kind = 'visit' AND (date > DATE '{TODAY}' OR (date = DATE '{TODAY}' AND end_min >= {NOW_MIN}))) WHERE rn = 1""")
def j12(spark, root):
    from waymark.plans.shaping import stops

    return next_activity(stops(spark, root).where("kind = 'visit'"), TODAY, NOW_MIN).select(
        "plan", F.date_format("date", "yyyy-MM-dd").alias("date"), "start_min", "place"
    )


def next_activity(rows, today, now_min, extra=()):
    """First activity per plan not over at (today, now_min): a partially aggregated minimum."""
    day = F.lit(today).cast("date")
    ahead = rows.where((F.col("date") > day) | ((F.col("date") == day) & (F.col("end_min") >= now_min)))
    return ahead.groupBy("plan").agg(F.min(F.struct("date", "start_min", "place", *extra)).alias("n")).select("plan", "n.*")


@query("J13_climate_lookup", f"""
  WITH climate AS (SELECT circuit, CAST(month(start_date) AS INT) AS m, min(trip % 20) - 2 AS t_min, max(trip % 20) + 12 AS t_max, max(trip % 230) / 10e0 AS mm FROM v_trips GROUP BY ALL),
  w AS (SELECT trip, circuit, CAST(month(end_date + 40) AS INT) AS m FROM v_trips),
  x AS (SELECT w.*, coalesce(c.t_min, 8 + w.m) AS t_min, coalesce(c.t_max, 20 + w.m) AS t_max, coalesce(c.mm, w.m / 2e0) AS mm FROM w LEFT JOIN climate c ON c.circuit = w.circuit AND c.m = w.m)
  SELECT trip, m, t_min, t_max, mm, CASE WHEN circuit % 11 = 0 AND mm > 10 THEN 1.5e0 WHEN circuit % 7 = 0 AND m IN (12, 1) THEN 1.8e0
    WHEN mm >= 15 THEN 2.5e0 WHEN mm >= 5 THEN 6e0 ELSE 12e0 END AS visibility FROM x""")
def j13(spark, root):
    trips = V.trips(spark, root)
    climate = trips.groupBy("circuit", F.month("start_date").alias("m")).agg(
        (F.min(F.col("trip") % 20) - 2).alias("t_min"), (F.max(F.col("trip") % 20) + 12).alias("t_max"),
        (F.max(F.col("trip") % 230) / 10.0).alias("mm"),
    )
    wanted = trips.select("trip", "circuit", F.month(F.date_add("end_date", 40)).alias("m"))
    found = wanted.join(climate, ["circuit", "m"], "left").withColumns({
        "t_min": F.coalesce("t_min", F.col("m") + 8), "t_max": F.coalesce("t_max", F.col("m") + 20),
        "mm": F.coalesce("mm", F.col("m") / 2.0),
    })
    visibility = (
        F.when((F.col("circuit") % 11 == 0) & (F.col("mm") > 10), 1.5)
        .when((F.col("circuit") % 7 == 0) & F.col("m").isin(12, 1), 1.8)
        .when(F.col("mm") >= 15, 2.5).when(F.col("mm") >= 5, 6.0).otherwise(12.0)
    )
    return found.select("trip", "m", "t_min", "t_max", "mm", visibility.alias("visibility"))


@query("J14_trip_days", "SELECT trip, day_index, strftime(date, '%Y-%m-%d') AS date FROM v_trip_days")
def j14(spark, root):
    return trip_days(V.trips(spark, root)).select("trip", "day_index", F.date_format("date", "yyyy-MM-dd").alias("date"))


CACHE_NOW = "1999-01-01"


@query("J15_ttl_cache_join", f"""
  WITH c AS (SELECT l_orderkey AS trip, CAST(l_linenumber % 5 AS INT) AS day_index, max(l_shipdate) AS fetched, max(l_quantity) AS value FROM lineitem GROUP BY ALL)
  SELECT w.trip, w.day_index, fetched IS NULL OR fetched < TIMESTAMP '{CACHE_NOW}' - INTERVAL 365 DAY AS stale,
    CASE WHEN fetched IS NULL OR fetched < TIMESTAMP '{CACHE_NOW}' - INTERVAL 365 DAY THEN w.day_index * 10e0 ELSE value END AS value
  FROM v_trip_days w LEFT JOIN c ON c.trip = w.trip AND c.day_index = w.day_index""")
def j15(spark, root):
    wanted = trip_days(V.trips(spark, root)).select("trip", "day_index")
    cached = table(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("trip"), F.expr("cast(l_linenumber % 5 as int)").alias("day_index")).agg(
        F.max("l_shipdate").alias("fetched"), F.max("l_quantity").alias("value")
    )
    return ttl_join(wanted, cached, ["trip", "day_index"], F.lit(CACHE_NOW).cast("timestamp"), 365, F.col("day_index") * F.lit(10.0))


def ttl_join(wanted, cached, keys, now, ttl_days, refreshed):
    """Cached value while fresh; a missing, null or old snapshot is stale and takes the refreshed value."""
    joined = wanted.join(cached, keys, "left")
    stale = F.col("fetched").isNull() | (F.col("fetched") < now - F.make_dt_interval(days=F.lit(ttl_days)))
    return joined.select(*keys, stale.alias("stale"), F.when(stale, refreshed).otherwise(F.col("value")).alias("value"))


_J16_KM, _J16_MIN = leg_sql("a.lat", "a.lon", "b.lat", "b.lon", "a.mode")
VIEWS["v_day_pool"] = f"""
  SELECT plan, day, place, lat, lon, CAST(rn - 1 AS INT) AS i, mode FROM (
    SELECT s.plan, s.day, s.place, s.lat, s.lon, t.mode, row_number() OVER (PARTITION BY s.plan, s.day ORDER BY min(s.start_min), s.place) AS rn
    FROM v_stops s JOIN v_trips t ON t.trip = s.plan GROUP BY s.plan, s.day, s.place, s.lat, s.lon, t.mode)"""


@query("J16_leg_matrix", f"SELECT a.plan, a.day, a.i, b.i AS j, {_J16_KM} AS km, {_J16_MIN} AS minutes FROM v_day_pool a JOIN v_day_pool b ON a.plan = b.plan AND a.day = b.day AND a.i <> b.i")
def j16(spark, root):
    from waymark.plans.shaping import stops

    modes = V.trips(spark, root).select(F.col("trip").alias("plan"), "mode")
    visits = stops(spark, root).groupBy("plan", "day", "place", "lat", "lon").agg(F.min("start_min").alias("start_min"))
    return leg_matrix(visits, modes)


def leg_matrix(visits, modes):
    """Legs i -> j, both ways, between all stops of a day: an equi-join, so no array holds a day.

    The number of parts follows the number of stops, so a task sorts no more of them on larger input.
    """
    bucket = F.coalesce(F.floor(F.col("start_min") / 60), F.lit(-1))
    ranked = grouped.ranked(visits, ["plan", "day"], bucket, [F.col("start_min"), F.col("place")], "rn")
    numbered = cut_in_parts(ranked.select("plan", "day", "lat", "lon", (F.col("rn") - 1).cast("int").alias("i")), "numbered")
    starts = cut_in_parts(numbered.join(modes, "plan"), "starts")
    parts = max(int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions")), numbered.count() // STOPS_AT_ONCE)
    a = starts.select("plan", "day", "mode", "i", F.col("lat").alias("lat1"), F.col("lon").alias("lon1")).repartition(parts, "plan", "day")
    b = numbered.select("plan", "day", F.col("i").alias("j"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")).repartition(parts, "plan", "day")
    est = geo.leg(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), F.col("mode"))
    legs = a.join(b, ["plan", "day"]).where("i <> j").withColumn("leg", est)
    return legs.select("plan", "day", "i", "j", "leg.km", "leg.minutes")


@query("J17_route_cache", """
  WITH e AS (SELECT a.place, a.kind, round(a.lat, 4) AS la, round(a.lon, 4) AS lo, round(b.lat, 4) AS lb, round(b.lon, 4) AS lob
    FROM v_places a JOIN v_places b ON b.place IN (a.place, a.place + 1, a.place + 2, a.place + 3, a.place + 16, a.place + 5000000)),
  k AS (SELECT *, sha1('haversine|car|' || CASE WHEN (la, lo) <= (lb, lob) THEN la || ',' || lo || '|' || lb || ',' || lob ELSE lb || ',' || lob || '|' || la || ',' || lo END) AS cache_key FROM e),
  c AS (SELECT DISTINCT cache_key FROM k WHERE kind = 'indoor')
  SELECT k.cache_key, bool_or(c.cache_key IS NOT NULL) AS hit, count(c.cache_key) AS hits FROM k LEFT JOIN c ON c.cache_key = k.cache_key GROUP BY k.cache_key""")
def j17(spark, root):
    places = V.places(spark, root).select("place", "kind", "lat", "lon", F.col("nearby").alias("next"))
    edges = places.select("place", "kind", "lat", "lon", F.explode("next").alias("other"))
    ends = places.select(F.col("place").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    keyed = edges.join(ends, "other").select("kind", cache_key("lat", "lon", "lat2", "lon2", "car", "haversine").alias("cache_key"))
    cached = keyed.where("kind = 'indoor'").select("cache_key").distinct().withColumn("hit", F.lit(True))
    asked = keyed.groupBy("cache_key").agg(F.count("*").alias("asked"))
    hit = F.coalesce("hit", F.lit(False))
    return asked.join(cached, "cache_key", "left").select("cache_key", hit.alias("hit"), F.when(hit, F.col("asked")).otherwise(0).alias("hits"))


def cache_key(lat1, lon1, lat2, lon2, mode, provider):
    """Undirected: rounded end points in order, so both directions share a key."""
    point = lambda la, lo: F.struct(F.round(la, 4).alias("la"), F.round(lo, 4).alias("lo"))
    a, b = point(lat1, lon1), point(lat2, lon2)
    shown = lambda p: F.concat(p["la"].cast("string"), F.lit(","), p["lo"].cast("string"))
    return F.sha1(F.concat(F.lit(f"{provider}|{mode}|"), shown(F.least(a, b)), F.lit("|"), shown(F.greatest(a, b))))


@query("J19_member_profiles", """
  SELECT m.trip, 'member' || m.member AS name, coalesce(p.pref, 3e0) AS heritage, m.weight, m.mobility
  FROM v_members m LEFT JOIN v_prefs p ON p.member = m.member AND p.interest = 'heritage' JOIN v_trips t ON t.trip = m.trip WHERE m.status <> 'opted_out'
  UNION ALL SELECT trip, 'Traveller', 3e0, 1e0, 'full' FROM v_trips WHERE trip NOT IN (SELECT trip FROM v_members WHERE status <> 'opted_out')""")
def j19(spark, root):
    trips = V.trips(spark, root).select("trip")
    joined = V.members(spark, root).where("status <> 'opted_out'").join(trips, "trip").select(
        "trip", F.concat(F.lit("member"), "member").alias("name"), S.preference(F.col("heritage")).alias("heritage"), "weight", "mobility"
    )
    alone = trips.join(joined, "trip", "left_anti").select(
        "trip", F.lit("Traveller").alias("name"), F.lit(3.0).alias("heritage"), F.lit(1.0).alias("weight"), F.lit("full").alias("mobility")
    )
    return joined.unionByName(alone)


@query("J20_trip_context", f"""
  WITH c AS (SELECT circuit, avg(lat) AS lat, avg(lon) AS lon FROM v_places GROUP BY circuit)
  SELECT t.trip, t.circuit, {r('coalesce(t.origin_lat, c.lat)', 6)} AS base_lat, {r('coalesce(t.origin_lon, c.lon)', 6)} AS base_lon, t.days, t.pace FROM v_trips t JOIN c ON c.circuit = t.circuit""")
def j20(spark, root):
    centres = V.places(spark, root).groupBy("circuit").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return V.trips(spark, root).join(centres, "circuit").select(
        "trip", "circuit", rnd(F.coalesce("origin_lat", "lat"), 6).alias("base_lat"),
        rnd(F.coalesce("origin_lon", "lon"), 6).alias("base_lon"), "days", "pace",
    )


COVERS_SQL = "CASE t.topic " + " ".join(f"WHEN '{k}' THEN {sql_list(v)}" for k, v in K.TOPIC_COVERS.items()) + " END"


@query("J21_best_source_for_topic", f"""
  WITH t AS (SELECT unnest({sql_list(K.TOPICS)}) AS topic),
  x AS (SELECT p.place, t.topic, s.url, s.source_type, row_number() OVER (PARTITION BY p.place, t.topic
      ORDER BY CASE WHEN list_has_any(s.covers, {COVERS_SQL}) THEN 0 ELSE 1 END, s.pos) AS rn
    FROM v_places p CROSS JOIN t LEFT JOIN v_sources s ON s.place = p.place)
  SELECT place, topic, coalesce(url, 'https://www.example.org/default') AS url, coalesce(source_type, 'government') AS source_type FROM x WHERE rn = 1""")
def j21(spark, root):
    best = best_source(V.sources(spark, root))
    topics = F.array(*[F.lit(t) for t in K.TOPICS])
    wanted = V.places(spark, root).select("place", F.explode(topics).alias("topic"))
    return wanted.join(best, ["place", "topic"], "left").select(
        "place", "topic", F.coalesce("url", F.lit("https://www.example.org/default")).alias("url"),
        F.coalesce("source_type", F.lit("government")).alias("source_type"),
    )


def best_source(sources):
    """Per (place, topic) the first source covering the topic, else the first source."""
    fields = F.expr("map(" + ", ".join(f"'{t}', array({', '.join(repr(v) for v in f)})" for t, f in K.TOPIC_COVERS.items()) + ")")
    spread = sources.select("place", "pos", "url", "source_type", "covers", F.explode(fields).alias("topic", "fields"))
    order = F.struct((~F.arrays_overlap("covers", "fields")).alias("miss"), "pos")
    return spread.groupBy("place", "topic").agg(F.min_by(F.struct("url", "source_type"), order).alias("s")).select("place", "topic", "s.*")


@query("J22_name_lookup", """
  SELECT l_partkey AS place, count(*) AS stops, coalesce(p_name, CAST(l_partkey AS VARCHAR)) AS name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 GROUP BY ALL""")
def j22(spark, root):
    counts = table(spark, root, "lineitem").groupBy(F.col("l_partkey").alias("place")).agg(F.count("*").alias("stops"))
    names = table(spark, root, "part").where("p_size > 10").select(F.col("p_partkey").alias("place"), "p_name")
    return counts.join(names, "place", "left").select("place", "stops", F.coalesce("p_name", F.col("place").cast("string")).alias("name"))


@query("J23_nested_assembly", """
  SELECT p.place, coalesce(s.n, 0) AS schedules, coalesce(c.n, 0) AS fees, coalesce(u.n, 0) AS sources, coalesce(u.urls, '') AS urls FROM v_places p
  LEFT JOIN (SELECT place, count(*) AS n FROM v_sched GROUP BY 1) s ON s.place = p.place
  LEFT JOIN (SELECT place, 2 AS n FROM v_places) c ON c.place = p.place
  LEFT JOIN (SELECT place, count(*) AS n, string_agg(url, '|' ORDER BY pos) AS urls FROM v_sources GROUP BY 1) u ON u.place = p.place""")
def j23(spark, root):
    places = V.places(spark, root)
    return assembled(places.select("place"), schedule_rows(places), fee_rows(places), V.sources(spark, root))


def assembled(places, sched, fees, src):
    """Counts and urls of each place's children, summed over their parts before places are joined."""
    whole = lambda df: F.struct(*[c for c in df.columns if c != "place"])
    parts = lambda df, child, name: grouped.nest(df, "place", child, whole(df), name)
    size = lambda name: F.sum(F.size(name)).alias(name)
    schedules = parts(sched, F.struct("is_closed", "dow", "opens", "closes"), "schedules").groupBy("place").agg(size("schedules"))
    charged = parts(fees, F.struct("visitor", "amount_min", "amount_max"), "fees").groupBy("place").agg(size("fees"))
    urls = F.array_join(F.array_sort(F.flatten(F.collect_list("sources"))).getField("url"), "|").alias("urls")
    sources = parts(src, F.struct("pos", "url", "source_type", "covers"), "sources").groupBy("place").agg(size("sources"), urls)
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return places.join(schedules, "place", "left").join(charged, "place", "left").join(sources, "place", "left").select(
        "place", count("schedules"), count("fees"), count("sources"), F.coalesce("urls", F.lit("")).alias("urls"),
    )


@query("J24_trips_of_members", "SELECT trip, owner, strftime(start_date, '%Y-%m-%d') AS start FROM v_trips WHERE trip IN (SELECT trip FROM v_members WHERE status <> 'opted_out')")
def j24(spark, root):
    going = V.members(spark, root).where("status <> 'opted_out'").select("trip")
    return V.trips(spark, root).join(going, "trip", "left_semi").orderBy(F.desc("start_date"), "trip").select(
        "trip", "owner", F.date_format("start_date", "yyyy-MM-dd").alias("start")
    )


@query("J25_clamped_forecast", """
  WITH f AS (SELECT trip, day_index, t_max FROM v_weather WHERE day_index < 3)
  SELECT d.trip, d.day_index, f.t_max FROM v_trip_days d JOIN f ON f.trip = d.trip AND f.day_index = least(d.day_index, least(d.days, 3) - 1)""")
def j25(spark, root):
    from waymark.plans.shaping import weather

    days = trip_days(V.trips(spark, root)).select("trip", "day_index")
    forecast = weather(spark, root).where("day_index < 3").select("trip", F.col("day_index").alias("row"), "t_max")
    last = forecast.groupBy("trip").agg(F.max("row").alias("last"))
    at = days.join(last, "trip").withColumn("row", F.least("day_index", "last"))
    return at.join(forecast, ["trip", "row"]).select("trip", "day_index", "t_max")
