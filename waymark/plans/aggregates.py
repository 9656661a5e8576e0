"""Queries: aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import constants as K, text
from waymark.functions.stats import rate, rnd
from waymark.operators import metrics, shaping as S
from waymark.plans.registry import query
from waymark.plans.shaping import fee_rows, weather
from waymark.plans.view_sql import VIEWS, hav, rnd as r, sql_lookup, toks
from waymark.sources import views as V
from waymark.sources.tables import table

SPREAD_SQL = f"""SELECT cluster, {r('max(' + hav('clat', 'clon', 'lat', 'lon') + ')', 3)} AS spread_km FROM v_places
  JOIN (SELECT cluster, avg(lat) AS clat, avg(lon) AS clon FROM v_places GROUP BY 1) USING (cluster) GROUP BY cluster"""


@query("A1_cluster_metrics", f"""
  WITH sp AS ({SPREAD_SQL}), tg AS (SELECT cluster, count(DISTINCT tag) AS n_tags FROM (SELECT cluster, unnest(tags) AS tag FROM v_places) GROUP BY 1),
  m AS (SELECT cluster, count(*) AS n_places, {r('avg(quality)', 4)} AS mean_quality, {r("avg((access IN ('yes', 'partial'))::INT)", 4)} AS pct_accessible,
    {r("avg((kind IN ('indoor', 'mixed'))::INT)", 4)} AS pct_indoor, median(typ) AS median_minutes, {r('avg(unverified::INT)', 4)} AS pct_unverified,
    {r('avg(senior)', 3)} AS mean_senior, {r('avg(child)', 3)} AS mean_child FROM v_places GROUP BY cluster)
  SELECT m.*, tg.n_tags, sp.spread_km, n.n_name AS name FROM m JOIN tg USING (cluster) JOIN sp USING (cluster)
  LEFT JOIN nation n ON n.n_nationkey = CAST(substr(cluster, 7) AS INT)""")
def a1(spark, root):
    places = V.places(spark, root)
    attributes = table(spark, root, "nation").select(F.concat(F.lit("Brand#"), "n_nationkey").alias("cluster"), F.col("n_name").alias("name"))
    return metrics.cluster_metrics(places).join(metrics.spread(places, "cluster"), "cluster").join(attributes, "cluster", "left")


@query("A2_geo_spread", SPREAD_SQL)
def a2(spark, root):
    return metrics.spread(V.places(spark, root), "cluster")


@query("A3_max_fee", "SELECT place, fee_max AS cost, (SELECT max(fee_max) FROM v_places) AS top FROM v_places")
def a3(spark, root):
    adult = fee_rows(V.places(spark, root)).where("visitor = 'adult'")
    return S.max_fee(adult).withColumn("top", adult.agg(F.max("amount_max")).scalar())


@query("A4_source_strength", f"SELECT place, max({sql_lookup(K.SOURCE_FEATURE, 'source_type', 0.4)}) AS best_source, count(*) AS n_sources FROM v_sources GROUP BY place")
def a4(spark, root):
    return S.source_strength(V.sources(spark, root))


@query("A5_dashboard_scalars", f"""
  SELECT count(*) AS total, count(*) FILTER (start_date >= DATE '2001-08-01' - 90) AS recent, {r('avg(travellers)', 2)} AS mean_group,
    {r('coalesce(avg(budget), 0e0)', 2)} AS mean_budget, {r('avg(end_date - start_date)', 2)} AS mean_days,
    {r('(SELECT count(*) FROM v_members) / greatest(1, count(*))', 4)} AS members_per_trip FROM v_trips""")
def a5(spark, root):
    since = F.date_sub(F.lit("2001-08-01").cast("date"), 90)
    scalars = V.trips(spark, root).agg(
        F.count("*").alias("total"), F.count_if(F.col("start_date") >= since).alias("recent"), rnd(F.avg("travellers"), 2).alias("mean_group"),
        rnd(F.coalesce(F.avg("budget"), F.lit(0.0)), 2).alias("mean_budget"), rnd(F.avg(F.datediff("end_date", "start_date")), 2).alias("mean_days"),
    )
    people = table(spark, root, "events").agg(F.count_distinct("user_id"))
    return scalars.withColumn("n", people.scalar()).select(
        "total", "recent", "mean_group", "mean_budget", "mean_days", rnd(F.col("n") / F.greatest(F.lit(1), F.col("total")), 4).alias("members_per_trip")
    )


QUALITY = {"fairness": "l_discount", "least": "l_tax", "consensus": "l_quantity / 50e0", "km": "l_quantity", "stops": "l_linenumber", "cost_low": "l_extendedprice * 0.8e0", "cost_high": "l_extendedprice * 1.3e0"}


@query("A6_itinerary_quality", "SELECT " + ", ".join(f"{r(f'avg({e})', 4)} AS {n}" for n, e in QUALITY.items()) + " FROM lineitem WHERE l_returnflag IN ('A', 'N')")
def a6(spark, root):
    return table(spark, root, "lineitem").where("l_returnflag in ('A', 'N')").agg(*[rnd(F.avg(F.expr(e)), 4).alias(n) for n, e in QUALITY.items()])


@query("A7_itinerary_rates", f"""
  SELECT l_returnflag AS grp, coalesce({r('count(*) FILTER (l_tax = 0) / nullif(count(*), 0)', 4)}, 0e0) AS invalid_rate,
    coalesce({r('count(*) FILTER (l_linenumber > 1) / nullif(count(*), 0)', 4)}, 0e0) AS regeneration_rate,
    coalesce({r("count(*) FILTER (l_linestatus = 'O' AND l_discount > 5) / nullif(count(*) FILTER (l_discount > 5), 0)", 4)}, 0e0) AS explained_rate
  FROM lineitem GROUP BY 1""")
def a7(spark, root):
    return table(spark, root, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(
        rate(F.count_if(F.col("l_tax") == 0), F.count("*")).alias("invalid_rate"),
        rate(F.count_if(F.col("l_linenumber") > 1), F.count("*")).alias("regeneration_rate"),
        rate(F.count_if((F.col("l_linestatus") == "O") & (F.col("l_discount") > 5)), F.count_if(F.col("l_discount") > 5)).alias("explained_rate"),
    )


@query("A8_triggers_and_approvals", f"""
  SELECT trip, count(*) FILTER (value IN ('up', 'down')) AS removals, count(*) FILTER (value = 'up') AS applied,
    coalesce({r("count(*) FILTER (value = 'up') / nullif(count(*), 0)", 4)}, 0e0) AS approval_rate FROM v_votes GROUP BY trip""")
def a8(spark, root):
    up = F.count_if(F.col("value") == "up")
    return V.votes(spark, root).groupBy("trip").agg(
        F.count_if(F.col("value").isin("up", "down")).alias("removals"), up.alias("applied"), rate(up, F.count("*")).alias("approval_rate")
    )


@query("A9_feedback_acceptance", f"""
  SELECT l_linestatus AS grp, coalesce({r("count(*) FILTER (l_returnflag = 'A') / nullif(count(*) FILTER (l_returnflag <> 'N'), 0)", 4)}, 0e0) AS acceptance,
    {r('avg(CASE WHEN l_tax > 0 THEN l_linenumber END)', 2)} AS rating FROM lineitem GROUP BY 1""")
def a9(spark, root):
    accepted = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A")
    return table(spark, root, "lineitem").groupBy(F.col("l_linestatus").alias("grp")).agg(
        rate(F.count_if(accepted), F.count(accepted)).alias("acceptance"),
        rnd(F.avg(F.when(F.col("l_tax") > 0, F.col("l_linenumber"))), 2).alias("rating"),
    )


@query("A10_spend_accuracy", f"""
  SELECT count(*) AS samples, CASE WHEN count(*) > 0 THEN {r('count(*) FILTER (actual BETWEEN low AND high) / nullif(count(*), 0)', 4)} END AS within_range,
    {r('avg(abs(actual - (low + high) / 2) / nullif((low + high) / 2, 0e0))', 4)} AS mape FROM v_spend""")
def a10(spark, root):
    return metrics.spend_accuracy(V.spend(spark, root))


@query("A11_distinct_trips", "SELECT count(DISTINCT plan) AS with_plan FROM v_acts")
def a11(spark, root):
    return V.activities(spark, root).agg(F.count_distinct("plan").alias("with_plan"))


@query("A12_selection_stats", f"""
  SELECT l_partkey AS place, count(*) AS scored, count(*) FILTER (l_returnflag = 'A') AS selected, {r("count(*) FILTER (l_returnflag = 'A') / count(*)", 4)} AS selection_rate,
    {r('avg(l_discount)', 4)} AS mean_score FROM lineitem GROUP BY 1 ORDER BY scored DESC, place LIMIT 20""")
def a12(spark, root):
    return table(spark, root, "lineitem").groupBy(F.col("l_partkey").alias("place")).agg(
        F.count("*").alias("scored"), F.count_if(F.col("l_returnflag") == "A").alias("selected"),
        rate(F.count_if(F.col("l_returnflag") == "A"), F.count("*")).alias("selection_rate"), rnd(F.avg("l_discount"), 4).alias("mean_score"),
    ).orderBy(F.desc("scored"), "place").limit(20)


@query("A13_coverage_summary", f"""
  SELECT n_name AS name, count(c_custkey) AS n, {r('coalesce(avg(c_acctbal), 0e0)', 3)} AS mean_balance, CAST(coalesce(sum((c_acctbal < 0)::INT), 0) AS BIGINT) AS negative,
    strftime(min(first_order), '%Y-%m-%d') AS oldest FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY n_name""")
def a13(spark, root):
    firsts = table(spark, root, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
    owners = table(spark, root, "customer").join(firsts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return table(spark, root, "nation").join(owners, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("name")).agg(
        F.count("c_custkey").alias("n"), rnd(F.coalesce(F.avg("c_acctbal"), F.lit(0.0)), 3).alias("mean_balance"),
        F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.date_format(F.min("first_order"), "yyyy-MM-dd").alias("oldest"),
    ).orderBy("name")


RUN_AVGS = {"precision": "turn / 8e0", "faithfulness": "length(text) / 1000e0", "citations": "(conv_id % 5) / 4e0", "completeness": "(turn % 3) / 2e0", "latency": "length(text) + 0e0"}


@query("A14_run_rollup", "SELECT conv_id // 10 AS run, count(*) AS questions, " + ", ".join(f"{r(f'avg({e})', 4)} AS {n}" for n, e in RUN_AVGS.items()) + ", CAST(sum((role = 'system')::INT) AS BIGINT) AS abstained FROM conversations GROUP BY 1")
def a14(spark, root):
    return table(spark, root, "conversations").groupBy(F.expr("conv_id div 10").alias("run")).agg(
        F.count("*").alias("questions"), *[rnd(F.avg(F.expr(e)), 4).alias(n) for n, e in RUN_AVGS.items()], F.count_if(F.col("role") == "system").alias("abstained")
    ).orderBy(F.desc("run"))


@query("A15_evaluation_averages", "SELECT count(*) AS evaluations, " + ", ".join(f"{r(f'coalesce(avg({e}), 0e0)', 4)} AS {n}" for n, e in RUN_AVGS.items()) + " FROM conversations")
def a15(spark, root):
    return table(spark, root, "conversations").agg(F.count("*").alias("evaluations"), *[rnd(F.coalesce(F.avg(F.expr(e)), F.lit(0.0)), 4).alias(n) for n, e in RUN_AVGS.items()])


@query("A16_cluster_detail", """
  SELECT cluster, (SELECT string_agg(tag, '|' ORDER BY tag) FROM (SELECT DISTINCT unnest(tags) AS tag FROM v_places q WHERE q.cluster = p.cluster)) AS tags,
    count(*) FILTER (access IN ('yes', 'partial')) AS accessible, count(*) FILTER (kind IN ('indoor', 'mixed')) AS indoor,
    count(*) FILTER (senior >= 4) AS senior_ok, count(*) FILTER (child >= 4) AS child_ok, count(*) AS total FROM v_places p GROUP BY cluster""")
def a16(spark, root):
    return V.places(spark, root).groupBy("cluster").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))), "|").alias("tags"),
        F.count_if(F.col("access").isin("yes", "partial")).alias("accessible"), F.count_if(F.col("kind").isin("indoor", "mixed")).alias("indoor"),
        F.count_if(F.col("senior") >= 4).alias("senior_ok"), F.count_if(F.col("child") >= 4).alias("child_ok"), F.count("*").alias("total"),
    )


@query("A17_cost_band", """
  SELECT p_partkey AS place, coalesce(min(l_extendedprice) FILTER (l_returnflag <> 'R'), 0e0) AS low, coalesce(max(l_extendedprice) FILTER (l_returnflag <> 'R'), 0e0) AS high
  FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def a17(spark, root):
    adult = F.col("l_returnflag") != "R"
    bands = table(spark, root, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.min(F.when(adult, F.col("l_extendedprice"))).alias("low"), F.max(F.when(adult, F.col("l_extendedprice"))).alias("high")
    )
    return table(spark, root, "part").select("p_partkey").join(bands, "p_partkey", "left").select(
        F.col("p_partkey").alias("place"), F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high")
    )


VIEWS["v_tally"] = """
  SELECT trip, subject, count(*) FILTER (value = 'up') AS up, count(*) FILTER (value = 'down') AS down, count(*) FILTER (value = 'abstain') AS abstain
  FROM (SELECT *, row_number() OVER (PARTITION BY trip, member, subject ORDER BY ts DESC, vote DESC) AS rn FROM v_votes) WHERE rn = 1 GROUP BY ALL"""


@query("A18_vote_tally", "SELECT t.*, coalesce(e.n, 0) AS electorate FROM v_tally t LEFT JOIN (SELECT trip, count(*) AS n FROM v_members WHERE status = 'joined' GROUP BY 1) e ON e.trip = t.trip")
def a18(spark, root):
    electorate = V.members(spark, root).where("status = 'joined'").groupBy("trip").agg(F.count("*").alias("n"))
    return metrics.tally(V.votes(spark, root)).join(electorate, "trip", "left").select("trip", "subject", "up", "down", "abstain", F.coalesce("n", F.lit(0)).alias("electorate"))


@query("A19_proposal_threshold", "SELECT trip, subject, up, subject % 3 + 1 AS required, CASE WHEN subject % 5 = 0 THEN 'closed' WHEN up >= subject % 3 + 1 THEN 'applied' ELSE 'open' END AS status FROM v_tally")
def a19(spark, root):
    required = F.col("subject") % 3 + 1
    status = F.when(F.col("subject") % 5 == 0, "closed").when(F.col("up") >= required, "applied").otherwise("open")
    return metrics.tally(V.votes(spark, root)).select("trip", "subject", "up", required.alias("required"), status.alias("status"))


@query("A20_service_health", f"""
  WITH x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts DESC, call DESC) AS rn FROM v_calls) WHERE rn <= 500),
  y AS (SELECT service, count(*) AS calls, count(*) FILTER (NOT ok) AS errors, count(*) FILTER (fallback) AS falls, list_sort(list(latency)) AS l, string_agg(DISTINCT provider, '|' ORDER BY provider) AS providers FROM x GROUP BY 1)
  SELECT service, calls, {r('errors / calls', 4)} AS error_rate, {r('falls / calls', 4)} AS fallback_rate, {r('l[CAST(floor(calls * 0.5e0) AS INT) + 1]', 2)} AS p50,
    {r('l[least(calls - 1, CAST(floor(calls * 0.95e0) AS INT)) + 1]', 2)} AS p95, {r('list_max(l)', 2)} AS max, providers FROM y""")
def a20(spark, root):
    return metrics.service_health(V.calls(spark, root))


@query("A21_weather_summary", "SELECT trip, count(*) AS days, count(*) FILTER (wet) AS wet_days, count(*) FILTER (hot) AS hot_days, bool_or(is_fallback) AS any_fallback FROM v_weather GROUP BY trip")
def a21(spark, root):
    return weather(spark, root).withColumns(S.weather_flags()).groupBy("trip").agg(
        F.count("*").alias("days"), F.count_if("wet").alias("wet_days"), F.count_if("hot").alias("hot_days"), F.bool_or("is_fallback").alias("any_fallback")
    )


@query("A23_document_frequency", f"SELECT term, count(*) AS df, (SELECT count(*) FROM v_chunks) AS n_chunks FROM (SELECT chunk, unnest(list_distinct({toks('''heading || ' ' || body''')})) AS term FROM v_chunks) GROUP BY term")
def a23(spark, root):
    chunks = V.chunks(spark, root)
    terms = chunks.select(F.explode(F.array_distinct(text.tokens(F.concat_ws(" ", "heading", "body")))).alias("term"))
    size = chunks.agg(F.count("*")).scalar()
    return terms.groupBy("term").agg(F.count("*").alias("df")).withColumn("n_chunks", size)


@query("A24_needs_of_members", """
  SELECT t.trip, t.needs_access OR coalesce(m.w, false) AS needs_access, t.seniors OR coalesce(m.s, false) AS seniors, t.children OR coalesce(m.c, false) AS children
  FROM v_trips t LEFT JOIN (SELECT trip, bool_or(mobility = 'wheelchair') AS w, bool_or(is_senior) AS s, bool_or(is_child) AS c FROM v_members GROUP BY 1) m ON m.trip = t.trip""")
def a24(spark, root):
    needs = V.members(spark, root).groupBy("trip").agg(
        F.bool_or(F.col("mobility") == "wheelchair").alias("w"), F.bool_or("is_senior").alias("s"), F.bool_or("is_child").alias("c")
    )
    either = lambda own, other: (F.col(own) | F.coalesce(other, F.lit(False))).alias(own)
    return V.trips(spark, root).join(needs, "trip", "left").select("trip", either("needs_access", "w"), either("seniors", "s"), either("children", "c"))


@query("A25_topics_of_places", "SELECT place, string_agg(DISTINCT topic, '|' ORDER BY topic) AS topics FROM v_chunks GROUP BY place")
def a25(spark, root):
    return V.chunks(spark, root).groupBy("place").agg(F.array_join(F.array_sort(F.collect_set("topic")), "|").alias("topics"))


@query("A26_day_theme", """
  SELECT plan, day, CASE WHEN count(*) = 1 THEN arg_min(name, CAST(start_min AS BIGINT) * 10000000 + place) ELSE arg_min(name, CAST(start_min AS BIGINT) * 10000000 + place) || ' + ' || (count(*) - 1) || ' more' END AS theme
  FROM v_stops WHERE kind = 'visit' GROUP BY plan, day""")
def a26(spark, root):
    names = table(spark, root, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("name"))
    first = F.min_by("name", F.struct("start_min", "place"))
    theme = F.when(F.count("*") == 1, first).otherwise(F.concat(first, F.lit(" + "), (F.count("*") - 1).cast("string"), F.lit(" more")))
    return V.activities(spark, root).where("kind = 'visit'").join(names, "place").groupBy("plan", "day").agg(theme.alias("theme"))
