"""Queries: streaming-shaped operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import geo, text
from waymark.functions.stats import rnd
from waymark.plans.joins import TODAY, next_activity
from waymark.plans.registry import query
from waymark.plans.shaping import leg_sql
from waymark.plans.view_sql import VIEWS, hav, rnd as r
from waymark.plans.windows import latest_positions
from waymark.session import cut, work_path
from waymark.sources import views as V
from waymark.sources.tables import table
from waymark.streaming import runs, sharing


@query("ST1_private_ingest", """
  SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '"}' AS props FROM events""")
def st1(spark, root):
    stream = runs.event_stream(spark, root)
    noisy = F.concat(F.lit('{"lat":"1.5","k":'), F.get_json_object("props", "$.k"), F.lit(',"Coords":"x"}'))
    return runs.append_run(stream.select("event_id", text.strip_private(noisy).alias("props")), "ingest")


@query("ST2_daily_counts", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def st2(spark, root):
    """On-time counts, with the late rows added on reading."""
    rows, late = runs.count_run(runs.event_stream(spark, root), "2 days", daily_counts, ["event_type", "day"], "daily")
    return rows.unionByName(daily_counts(late)).groupBy("event_type", "day").agg(F.sum("n").alias("n"))


def daily_counts(events):
    return events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("ST3_sliding_counts", """
  SELECT event_type, w AS start, count(*) AS hits, count(*) > 1 AS over FROM (
    SELECT event_type, unnest(range(epoch_us(ts) // 10000000 * 10 - 50, epoch_us(ts) // 10000000 * 10 + 10, 10)) AS w FROM events) GROUP BY ALL""")
def st3(spark, root):
    """On-time counts of sliding windows, with the late rows added on reading."""
    rows, late = runs.count_run(runs.event_stream(spark, root), "10 minutes", sliding_counts, ["event_type", "start"], "sliding")
    hits = rows.unionByName(sliding_counts(late)).groupBy("event_type", "start").agg(F.sum("n").alias("hits"))
    return hits.withColumn("over", F.col("hits") > 1)


def sliding_counts(events):
    window = F.window("ts", "60 seconds", "10 seconds").alias("w")
    return events.groupBy("event_type", window).agg(F.count("*").alias("n")).select("event_type", F.unix_seconds("w.start").alias("start"), "n")


@query("ST3_trailing_counts", """
  SELECT event_id, hits, hits > 3 AS over, CASE WHEN hits > 3 THEN greatest(0e0, round((f + 3600000000 - at_us) / 1e6, 1)) ELSE 0e0 END AS retry_after FROM (
    SELECT event_id, epoch_us(ts) AS at_us, count(*) OVER w AS hits, min(epoch_us(ts)) OVER w AS f FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))""")
def st3b(spark, root):
    events = table(spark, root, "events").select("event_id", "event_type", "ts")
    return runs.trailing_requests(events, "event_type", 3600, 3).select("event_id", "hits", "over", "retry_after")


# one step of the recursion is one event of a member, in order of time; what is still open expires up to the watermark
VIEWS["v_sharing"] = f"""
  SELECT user_id // 5 * 97 AS trip, user_id AS member, epoch_us(ts) AS at_us, json_extract_string(props, '$.k')::INT AS k,
    CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'stop' WHEN 'purchase' THEN CASE WHEN json_extract_string(props, '$.k')::INT % 2 = 0 THEN 'pause' ELSE 'resume' END ELSE 'point' END AS kind,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE ts IS NOT NULL"""
ST4_SQL = f"""
  WITH RECURSIVE a AS MATERIALIZED (SELECT * FROM v_sharing),
  s AS (
    SELECT DISTINCT trip, member, 0::BIGINT AS rn, NULL::BIGINT AS started, NULL::BIGINT AS expires, 0 AS starts, 0 AS pauses, 0 AS points, 0 AS refused, false AS paused,
      NULL::STRUCT(started BIGINT, ended BIGINT, starts INT, pauses INT, points_kept INT, points_deleted INT, points_refused INT, outcome VARCHAR) AS closed FROM a
    UNION ALL
    SELECT trip, member, rn,
      CASE WHEN kind = 'start' AND NOT live THEN at_us WHEN live AND kind <> 'stop' THEN started END,
      CASE WHEN kind = 'start' THEN at_us + greatest(1, least(coalesce(k % 15, 0), {sharing.MOST_HOURS})) * {sharing.HOUR} WHEN live AND kind <> 'stop' THEN expires END,
      CASE WHEN live THEN starts ELSE 0 END + (kind = 'start')::INT, CASE WHEN live THEN pauses ELSE 0 END + (live AND kind = 'pause' AND NOT paused)::INT,
      CASE WHEN live THEN points ELSE 0 END + (live AND kind = 'point' AND NOT paused)::INT, CASE WHEN live THEN refused ELSE 0 END + (live AND kind = 'point' AND paused)::INT,
      CASE kind WHEN 'start' THEN false WHEN 'pause' THEN live WHEN 'resume' THEN false ELSE live AND paused END,
      CASE WHEN started IS NOT NULL AND NOT live THEN {{'started': started, 'ended': expires, 'starts': starts, 'pauses': pauses, 'points_kept': points, 'points_deleted': 0, 'points_refused': refused, 'outcome': 'expired'}}
        WHEN live AND kind = 'stop' THEN {{'started': started, 'ended': at_us, 'starts': starts, 'pauses': pauses, 'points_kept': 0, 'points_deleted': points, 'points_refused': refused, 'outcome': 'stopped'}} END
    FROM (SELECT s.trip, s.member, a.rn, a.at_us, a.kind, a.k, s.started, s.expires, s.starts, s.pauses, s.points, s.refused, s.paused, coalesce(a.at_us < s.expires, false) AS live
      FROM s JOIN a ON a.trip = s.trip AND a.member = s.member AND a.rn = s.rn + 1)),
  ends AS (
    SELECT trip, member, closed.* FROM s WHERE closed IS NOT NULL
    UNION ALL SELECT trip, member, started, expires, starts, pauses, points, 0, refused, 'expired' FROM (SELECT *, row_number() OVER (PARTITION BY trip, member ORDER BY rn DESC) AS back FROM s)
    WHERE back = 1 AND expires // 1000 <= (SELECT max(at_us) // 1000 - 3600000 FROM a))
  SELECT * FROM ends"""


@query("ST4_sharing_sessions", ST4_SQL)
def st4(spark, root):
    with sharing.timed_state(spark):
        return runs.append_run(sharing.sharing_sessions(runs.event_stream(spark, root, maxBytesPerTrigger=64 * 1024 * 1024)), "sharing")


@query("ST5_stream_positions", "SELECT trip, member, point FROM (SELECT *, row_number() OVER (PARTITION BY trip, member ORDER BY ts DESC, point DESC) AS rn FROM v_points) WHERE rn = 1 AND expires > TIMESTAMP '" + V.AS_OF + "'")
def st5(spark, root):
    k = F.get_json_object("props", "$.k").cast("int")
    stream = runs.event_stream(spark, root).where("event_type in ('click', 'view')").select(
        F.expr("(user_id div 5) * 97").alias("trip"), F.col("user_id").alias("member"), F.col("event_id").alias("point"), "ts",
        (F.col("ts") + F.make_dt_interval(hours=(F.lit(1) + k % 12) * 12)).alias("expires"),
    )
    with sharing.timed_state(spark):
        held = runs.update_run(sharing.latest_positions(stream), ["trip", "member"], "positions")
    return held.where(F.col("expires") > F.lit(V.AS_OF).cast("timestamp")).select("trip", "member", "point")


@query("ST6_retention_purge", f"""
  SELECT (SELECT count(*) FROM v_points WHERE expires <= TIMESTAMP '{V.AS_OF}') AS points_deleted,
    (SELECT count(*) FROM v_points WHERE expires > TIMESTAMP '{V.AS_OF}' AND session NOT IN (SELECT session FROM v_sessions)) AS orphans_deleted,
    (SELECT count(*) FROM v_sessions WHERE session_expires <= TIMESTAMP '{V.AS_OF}' AND status IN ('active', 'paused')) AS sessions_expired,
    (SELECT count(*) FROM v_points WHERE expires > TIMESTAMP '{V.AS_OF}' AND session IN (SELECT session FROM v_sessions)) AS points_remaining""")
def st6(spark, root):
    kept, sessions, counts = purge(V.points(spark, root), V.sessions(spark, root), F.lit(V.AS_OF).cast("timestamp"))
    return counts


def purge(points, sessions, now):
    """Points without the expired and the orphaned, sessions with expiry applied, and four counts."""
    marked = points.join(sessions.select("session", F.lit(True).alias("known")), "session", "left").withColumn(
        "fate", F.when(F.col("expires") <= now, "expired").when(F.col("known").isNull(), "orphan").otherwise("kept")
    )
    ends = (F.col("session_expires") <= now) & F.col("status").isin("active", "paused")
    updated = sessions.withColumn("status", F.when(ends, "expired").otherwise(F.col("status")))
    expired = sessions.agg(F.count_if(ends))
    fate = lambda f: F.count_if(F.col("fate") == f)
    counts = marked.agg(fate("expired").alias("points_deleted"), fate("orphan").alias("orphans_deleted"), fate("kept").alias("points_remaining")).withColumn("sessions_expired", expired.scalar())
    return marked.where("fate = 'kept'").drop("known", "fate"), updated, counts


_EK, _EM = leg_sql("l.lat", "l.lon", "n.nlat", "n.nlon", "'car'")
VIEWS["v_next"] = f"""
  SELECT plan, lat AS nlat, lon AS nlon FROM (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY date, start_min, place) AS rn FROM v_stops WHERE kind = 'visit' AND (date > DATE '{TODAY}' OR (date = DATE '{TODAY}' AND end_min >= 600))) WHERE rn = 1"""


@query("ST7_group_status", f"""
  WITH c AS (SELECT trip, avg(lat) AS clat, avg(lon) AS clon, count(*) AS sharing FROM v_latest GROUP BY trip),
  s AS (SELECT trip, max({hav('clat', 'clon', 'lat', 'lon')}) AS far FROM v_latest JOIN c USING (trip) GROUP BY trip)
  SELECT l.trip, l.member, c.sharing, {r('c.clat', 5)} AS centre_lat, {r('c.clon', 5)} AS centre_lon, {r('s.far', 3)} AS max_separation, s.far > 1.5 AS warning,
    round({_EK} + 1e-9, 2) AS next_km, round({_EM} + 1e-9, 0) AS next_minutes
  FROM v_latest l JOIN c ON c.trip = l.trip JOIN s ON s.trip = l.trip LEFT JOIN v_next n ON n.plan = l.trip""")
def st7(spark, root):
    from waymark.plans.shaping import stops

    ahead = next_activity(stops(spark, root).where("kind = 'visit'"), TODAY, 600, ("lat", "lon")).select(F.col("plan").alias("trip"), F.col("lat").alias("nlat"), F.col("lon").alias("nlon"))
    return group_status(latest_positions(spark, root), ahead)


def group_status(positions, ahead):
    """Centroid, largest separation with warning, and each member's estimate to the next stop."""
    centre = positions.groupBy("trip").agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon"), F.count("*").alias("sharing"))
    placed = positions.join(centre, "trip").withColumn("km", geo.haversine_km(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon")))
    far = placed.groupBy("trip").agg(F.max("km").alias("far"))
    est = geo.leg(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon"), F.lit("car"))
    rows = placed.join(far, "trip").join(ahead, "trip", "left").withColumn("leg", est)
    return rows.select(
        "trip", "member", "sharing", rnd(F.col("clat"), 5).alias("centre_lat"), rnd(F.col("clon"), 5).alias("centre_lon"), rnd(F.col("far"), 3).alias("max_separation"),
        (F.col("far") > 1.5).alias("warning"), rnd(F.col("leg.km"), 2).alias("next_km"), rnd(F.col("leg.minutes"), 0).alias("next_minutes"),
    )


@query("ST8_rolling_health")
def st8(spark, root):
    """Percentile from merged sketches: no exact twin; ST8_health_check holds it against exact ranks."""
    return health(spark, root)


CALLS = """SELECT event_type AS service, epoch_us(ts) AS at_us, value, json_extract_string(props, '$.k')::INT AS k, CASE WHEN event_type = 'error' THEN json_extract_string(props, '$.k')::INT % 2 = 0
  ELSE json_extract_string(props, '$.k')::INT % 13 <> 0 END AS ok FROM events"""


@query("ST8_health_check", f"""
  SELECT service, make_timestamp(start * 1000000) AS start, count(*) AS calls, {r("count(*) FILTER (NOT ok) / CAST(count(*) AS DOUBLE)", 4)} AS error_rate,
    {r("count(*) FILTER (k % 10 = 0) / CAST(count(*) AS DOUBLE)", 4)} AS fallback_rate, true AS close FROM (
    SELECT *, unnest(range(at_us // 21600000000 * 21600 - 64800, at_us // 21600000000 * 21600 + 1, 21600)) AS start FROM ({CALLS})) GROUP BY service, start""")
def st8b(spark, root):
    """Counts and rates, and whether the percentile lies within two per cent of the ranks of the window's values."""
    found = cut(health(spark, root), "health")
    pane = F.floor(F.unix_seconds("ts") / runs.PANE) * runs.PANE
    start = F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.timestamp_seconds(pane - i * runs.PANE)))
    values = calls(table(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))).where("value is not null").select("service", start.alias("start"), "value")
    ranks = found.join(values, ["service", "start"], "left").groupBy("service", "start", "calls", "error_rate", "fallback_rate").agg(
        F.count("value").alias("n"), F.count_if(F.col("value") < F.col("p95")).alias("below"), F.count_if(F.col("value") <= F.col("p95")).alias("upto")
    )
    close = (F.col("n") == 0) | ((F.col("below") <= 0.97 * F.col("n") + 1) & (F.col("upto") >= 0.93 * F.col("n") - 1))
    return ranks.select("service", F.col("start").cast("timestamp_ntz").alias("start"), "calls", "error_rate", "fallback_rate", close.alias("close"))


def calls(events):
    k = F.get_json_object("props", "$.k").cast("int")
    ok = F.when(F.col("event_type") == "error", k % 2 == 0).otherwise(k % 13 != 0)
    return events.select(F.col("event_type").alias("service"), "ts", "value", ok.alias("ok"), (k % 10 == 0).alias("fallback"))


def health(spark, root):
    panes, late = runs.health_run(calls(runs.event_stream(spark, root)), "1 hour", "health")
    return runs.rolling_health(panes.unionByName(runs.health_panes(late)))


@query("ST9_deduplicated_ingest", "SELECT sha256(event_type || '|' || user_id || '|' || epoch_us(ts)) AS content_hash, event_type FROM events")
def st9(spark, root):
    stream = runs.event_stream(spark, root)
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    hashed = twice.withColumn("content_hash", F.sha2(F.concat_ws("|", "event_type", "user_id", F.unix_micros("ts")), 256))
    unique, late = runs.unique_run(hashed.select("content_hash", "event_type", "ts"), "1 day", "content_hash", "unique")
    return unique.unionByName(late.select(unique.columns)).groupBy("content_hash").agg(F.min("event_type").alias("event_type"))


@query("ST10_cache_pruning", "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 10 DAY")
def st10(spark, root):
    cache = table(spark, root, "events").select("event_id", "ts", "value")
    path = work_path(spark, "cache")
    prune(cache, F.lit("2024-01-30").cast("timestamp"), 10).write.parquet(path)
    return spark.read.parquet(path).select("event_id", "value")


def prune(cache, now, days):
    return cache.where(F.col("ts") >= now - F.make_dt_interval(days=F.lit(days)))


@query("ST11_late_events")
def st11(spark, root):
    """Late rows depend on how input arrives in micro-batches: no SQL twin; every row lands in one of two tables."""
    return late_by_user(spark, root).groupBy("late").agg(F.count("*").alias("n"))


@query("ST11_nothing_lost", "SELECT event_type, count(*) AS n, true AS late_are_old FROM events GROUP BY event_type")
def st11b(spark, root):
    """Both tables together hold every row once, and no row of the late one is within the delay of the newest."""
    out = cut(late_by_user(spark, root), "split")
    newest = out.agg(F.max("ts").alias("newest"))
    old = F.coalesce(F.bool_and(F.when(F.col("late"), F.col("ts") < F.col("newest") - F.expr("interval 5 days"))), F.lit(True))
    # one row of one value: broadcast
    return out.join(F.broadcast(newest)).groupBy("event_type").agg(F.count("*").alias("n"), old.alias("late_are_old"))


def late_by_user(spark, root):
    """Arrival order differs from event order: files are ranges of the user, not of time."""
    staged = work_path(spark, "arrivals")
    table(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartitionByRange(3, "user_id").write.parquet(staged)
    return route_late(runs.event_stream(spark, staged, "*.parquet", maxFilesPerTrigger=1).select("event_id", "event_type", "ts"), spark, "5 days")


def route_late(stream, spark, delay):
    """Rows older than the high mark of earlier batches minus ``delay`` go to the late table."""
    path = work_path(spark, "late")

    def write(rows, epoch, line):
        rows.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")

    late = runs.split_run(stream, delay, write, path).withColumn("late", F.lit(True))
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(stream.columns).withColumn("late", F.lit(False)).unionByName(late)
