"""Queries: group ranking, fairness, day clustering and day filling."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions import constants as K
from waymark.functions.stats import rnd
from waymark.operators import days as D
from waymark.operators import fairness as G
from waymark.operators import grouped, shaping as S
from waymark.functions.text import message_list
from waymark.plans.ranking import top_components
from waymark.plans.registry import query
from waymark.plans.shaping import EVIDENCE_SQL, STRENGTH, weather
from waymark.plans.view_sql import VIEWS, hav, rnd as r, sql_lookup
from waymark.session import cut
from waymark.sources import views as V


def grid(spark, root):
    return G.utility_grid(V.trips(spark, root), V.members(spark, root), V.places(spark, root))


def scored(spark, root):
    return G.scored(V.trips(spark, root), V.members(spark, root), V.places(spark, root), V.sources(spark, root), weather(spark, root))


VIEWS["v_rules"] = f"""
  SELECT trip, place, {r('avg(u)', 6)} AS simple, {r('sum(u * weight) / sum(weight)', 6)} AS weighted, min(u) AS least,
    {r('greatest(0e0, least(1.5e0, 0.65e0 * sum(u * weight) / sum(weight) + 0.35e0 * min(u)))', 6)} AS fair FROM v_utility GROUP BY trip, place"""
VIEWS["v_borda"] = f"""
  SELECT trip, place, {r('sum((n - rk - (ties - 1) / 2e0) * weight) / ((max(n) - 1) * sum(weight))', 6)} AS borda FROM (
    SELECT *, rank() OVER (PARTITION BY member ORDER BY base DESC) AS rk, count(*) OVER (PARTITION BY member, base) AS ties, count(*) OVER (PARTITION BY member) AS n FROM (
      SELECT u.trip, u.member, u.weight, u.place, CASE WHEN list_contains(m.ranked, u.place) THEN 1e0 + (2 - (list_position(m.ranked, u.place) - 1)) ELSE u.u END AS base
      FROM v_utility u JOIN v_members m ON m.member = u.member)) GROUP BY trip, place"""


@query("J18_utility_grid", "SELECT trip, member, place, u FROM v_utility")
def j18(spark, root):
    return grid(spark, root).select("trip", "member", "place", "u")


@query("G1_member_utility", "SELECT trip, member, count(*) AS places, max(u) AS best, min(u) AS worst, round(avg(u) + 1e-9, 6) AS mean FROM v_utility GROUP BY trip, member")
def g1(spark, root):
    return grid(spark, root).groupBy("trip", "member").agg(
        F.count("*").alias("places"), F.max("u").alias("best"), F.min("u").alias("worst"), rnd(F.avg("u"), 6).alias("mean")
    )


@query("G2_aggregation_rules", "SELECT trip, place, simple, weighted, least FROM v_rules")
def g2(spark, root):
    return G.aggregated(grid(spark, root)).select("trip", "place", "simple", "weighted", "least")


VIEWS["v_top3"] = "SELECT trip, place FROM (SELECT trip, place, row_number() OVER (PARTITION BY trip ORDER BY simple DESC, place) AS rn FROM v_rules) WHERE rn <= 3"
COVERAGE = """SELECT {keys}, member, round(least(1e0, CASE WHEN max(len(must_places)) > 0
      THEN 0.7e0 * avg(u) FILTER (rn <= 5) + 0.3e0 * (count(*) FILTER (list_contains(must_places, place)) / CAST(max(len(must_places)) AS DOUBLE)) ELSE avg(u) FILTER (rn <= 5) END) + 1e-9, 6) AS value
  FROM (SELECT {keys}, member, must_places, place, u, row_number() OVER (PARTITION BY {keys}, member ORDER BY u DESC) AS rn FROM ({src})) GROUP BY {keys}, member"""
SATISFIED = f"""{r('avg(value)', 6)} AS mean, min(value) AS least, CASE WHEN sum(value) = 0 THEN 1e0 ELSE {r('pow(sum(value), 2) / (count(*) * sum(pow(value, 2)))', 6)} END AS jain,
  CASE WHEN count(*) < 2 THEN 1e0 ELSE {r('greatest(0e0, 1e0 - stddev_pop(value) / 0.5e0)', 6)} END AS consensus, {r('max(value) - min(value)', 6)} AS spread"""
VIEWS["v_coverage"] = COVERAGE.format(keys="trip", src="SELECT u.* FROM v_utility u JOIN v_top3 s ON s.trip = u.trip AND s.place = u.place")
VIEWS["v_deficits"] = f"SELECT c.trip, c.member, {r('greatest(0e0, m.mean - c.value)', 6)} AS deficit FROM v_coverage c JOIN (SELECT trip, {r('avg(value)', 6)} AS mean FROM v_coverage GROUP BY 1) m ON m.trip = c.trip"


def top3(g):
    return grouped.top_n(G.aggregated(g), ["trip"], [F.desc("simple"), F.col("place")], 3).select("trip", "place")


@query("G3_fairness_aware", f"""
  SELECT r.trip, r.place, r.fair, {r('greatest(0e0, least(1.5e0, 0.65e0 * x.w + 0.35e0 * x.l + 0.25e0 * x.b))', 6)} AS fair_with_deficits FROM v_rules r JOIN (
    SELECT u.trip, u.place, sum(u * weight) / sum(weight) AS w, min(u) AS l, sum(u * deficit) / count(*) AS b FROM v_utility u JOIN v_deficits d ON d.trip = u.trip AND d.member = u.member GROUP BY 1, 2) x
  ON x.trip = r.trip AND x.place = r.place""")
def g3(spark, root):
    g = grid(spark, root)
    behind = G.deficits(G.member_coverage(g, top3(g), ["trip"]))
    return G.aggregated(g).select("trip", "place", "fair").join(
        G.aggregated(g, behind).select("trip", "place", F.col("fair").alias("fair_with_deficits")), ["trip", "place"]
    )


@query("G4_borda_count", "SELECT trip, place, borda FROM v_borda")
@query("W6_borda_points", "SELECT trip, place, borda FROM v_borda")
def g4(spark, root):
    return G.borda(grid(spark, root))


@query("G5_selection_evaluation", f"SELECT trip, {SATISFIED}, arg_min(member, value * 1e9 + member) AS least_member FROM v_coverage GROUP BY trip")
def g5(spark, root):
    g = grid(spark, root)
    return G.satisfaction(G.member_coverage(g, top3(g), ["trip"]), ["trip"])


@query("G6_deficits", "SELECT trip, member, deficit FROM v_deficits")
def g6(spark, root):
    g = grid(spark, root)
    return G.deficits(G.member_coverage(g, top3(g), ["trip"]))


@query("K5_top_k_mean", f"SELECT trip, member, {r('avg(u)', 6)} AS top_mean FROM (SELECT *, row_number() OVER (PARTITION BY trip, member ORDER BY u DESC, place) AS rn FROM v_utility) WHERE rn <= 5 GROUP BY trip, member")
def k5(spark, root):
    best = grouped.top_n(grid(spark, root), ["trip", "member"], [F.desc("u"), F.col("place")], 5)
    return best.groupBy("trip", "member").agg(rnd(F.avg("u"), 6).alias("top_mean"))


DEMAND = "SELECT trip, interest, sum(coalesce(pref, 3e0)) / (5e0 * count(*)) AS demand FROM v_members m JOIN v_prefs p ON p.member = m.member WHERE m.status <> 'opted_out' AND trip IN (SELECT trip FROM v_trips) GROUP BY ALL"


@query("A22_interest_coverage", f"""
  WITH d AS ({DEMAND}), s AS (SELECT t.trip, i.interest, max(i.weight) AS supply FROM v_top3 t JOIN v_place_interest i ON i.place = t.place GROUP BY ALL)
  SELECT d.trip, d.interest, {r('d.demand', 4)} AS demand, {r('least(1e0, coalesce(s.supply, 0e0))', 4)} AS covered FROM d LEFT JOIN s ON s.trip = d.trip AND s.interest = d.interest WHERE d.demand > 0.35e0""")
def a22(spark, root):
    return interest_coverage(
        V.members(spark, root).join(V.trips(spark, root).select("trip"), "trip"), top3(grid(spark, root)), V.places(spark, root), ["trip"]
    ).select("trip", "interest", rnd(F.col("demand"), 4).alias("demand"), rnd(F.col("covered"), 4).alias("covered"))


def interest_coverage(members, selection, places, keys):
    """Interests a trip asks for (demand above 0.35) with the best supply in its selection."""
    pairs = F.array(*[F.struct(F.lit(i).alias("interest"), S.preference(F.col(i)).alias("pref")) for i in K.INTERESTS])
    demand = members.where("status <> 'opted_out'").select("trip", F.inline(pairs)).groupBy("trip", "interest").agg(
        (F.sum("pref") / (5.0 * F.count("*"))).alias("demand")
    ).where("demand > 0.35")
    supply = selection.join(S.interest_long(places, ["place"]), "place").groupBy(*keys, "interest").agg(F.max("weight").alias("supply"))
    wanted = selection.select(*keys).distinct().join(demand, "trip") if keys != ["trip"] else demand
    return wanted.join(supply, [*keys, "interest"], "left").withColumn(
        "covered", F.least(F.lit(1.0), F.coalesce("supply", F.lit(0.0)))
    )


# ------------------------------------------------------------------ scoring
EXPO = sql_lookup(K.EXPOSURE, "p.kind", 1.0)
VIEWS["v_needs"] = """
  SELECT trip, bool_or(is_senior) AS any_senior, bool_or(is_child) AS any_child, bool_or(mobility = 'wheelchair') AS any_wheelchair,
    bool_or(mobility = 'limited_walking') AS any_limited FROM v_members WHERE status <> 'opted_out' GROUP BY trip"""
VIEWS["v_pairs"] = f"""
  SELECT t.*, n.* EXCLUDE (trip), p.* EXCLUDE (circuit), {hav('t.base_lat', 't.base_lon', 'p.lat', 'p.lon')} AS km,
    EXISTS (SELECT 1 FROM v_members m WHERE m.trip = t.trip AND m.status <> 'opted_out' AND list_contains(m.must_places, p.place)) OR list_contains(t.must_own, p.place) AS mandatory,
    EXISTS (SELECT 1 FROM v_members m WHERE m.trip = t.trip AND m.status <> 'opted_out' AND list_contains(m.avoid_places, p.place)) AS vetoed,
    (SELECT count(DISTINCT d.day_index) FROM v_trip_days d JOIN v_windows w ON w.place = p.place AND w.wd = isodow(d.date) - 1 WHERE d.trip = t.trip) AS open_days,
    EXISTS (SELECT 1 FROM v_trip_days d JOIN v_windows w ON w.place = p.place AND w.wd = isodow(d.date) - 1 WHERE d.trip = t.trip
      AND least(w.closes, t.day_end) - greatest(w.opens, t.day_start) >= p.min_dur) AS fits
  FROM v_trips t JOIN v_needs n ON n.trip = t.trip JOIN v_places p ON p.circuit = t.circuit"""
VIEWS["v_reasons"] = """
  SELECT trip, place, array_to_string(list_filter([CASE WHEN list_contains(avoid_own, place) THEN 'excluded_by_group' END,
    CASE WHEN open_days = 0 THEN 'closed_for_entire_trip' END, CASE WHEN open_days > 0 AND NOT fits THEN 'cannot_fit_in_daily_window' END,
    CASE WHEN needs_access AND access = 'no' THEN 'not_wheelchair_accessible' END, CASE WHEN any_wheelchair AND access = 'no' THEN 'member_requires_step_free_access' END,
    CASE WHEN any_limited AND intensity >= 5 THEN 'too_physically_demanding_for_a_member' END,
    CASE WHEN fee_min > greatest(budget / days * 0.45e0, 150e0) AND budget IS NOT NULL THEN 'entry_fee_exceeds_budget' END, CASE WHEN vetoed THEN 'vetoed_by_member' END], lambda x: x IS NOT NULL), '|') AS reasons FROM v_pairs"""
VIEWS["v_wscore"] = f"""
  SELECT trip, place, {r('avg(s)', 4)} AS weather_suitability FROM (SELECT p.trip, p.place, greatest(0e0, least(1e0, 1e0
    - CASE WHEN wet THEN 0.75e0 * least(1e0, greatest(mm / 25e0, prob)) * {EXPO} * greatest(0.4e0, sens) ELSE 0e0 END
    - CASE WHEN hot THEN 0.45e0 * least(1e0, (t_max - 33) / 12e0) * {EXPO} ELSE 0e0 END - CASE WHEN cold THEN 0.35e0 * least(1e0, (3 - t_min) / 10e0) * {EXPO} ELSE 0e0 END
    - CASE WHEN low_visibility AND list_has_any(tags, ['viewpoint', 'photo-spot']) THEN 0.6e0 ELSE 0e0 END
    - CASE WHEN wind > 45 AND {EXPO} > 0.5e0 THEN 0.25e0 ELSE 0e0 END)) AS s FROM v_pairs p JOIN v_weather w ON w.trip = p.trip) GROUP BY trip, place"""
_calm = "(1e0 - (p.intensity - 1) / 4e0)"
_acc0 = sql_lookup(K.ACCESS_SCORING, "p.access", 0.35)
_acc1 = f"CASE WHEN p.seniors OR p.any_senior THEN 0.5e0 * {_acc0} + 0.5e0 * (p.senior / 5e0) ELSE {_acc0} END"
_acc2 = f"CASE WHEN p.children OR p.any_child THEN 0.6e0 * ({_acc1}) + 0.4e0 * (p.child / 5e0) ELSE {_acc1} END"
_acc3 = f"CASE WHEN p.needs_access OR p.seniors OR p.children THEN {_acc2} ELSE 0.35e0 + 0.65e0 * {_calm} END"
_acc4 = f"CASE WHEN p.any_limited THEN 0.5e0 * ({_acc3}) + 0.5e0 * {_calm} ELSE {_acc3} END"
_shared = "(len(list_intersect(m.tm, p.months)) / CAST(len(m.tm) AS DOUBLE))"
VIEWS["v_evidence"] = f"SELECT p.place, {EVIDENCE_SQL} AS evidence FROM v_places p LEFT JOIN (SELECT * FROM (WITH {STRENGTH} SELECT * FROM s)) s ON s.place = p.place"
VIEWS["v_components"] = f"""
  SELECT p.trip, p.place, p.name, p.kind, p.tags, p.mandatory, p.days, p.circuit, u.fair, u.least, {r('least(1e0, u.fair)', 4)} AS interest_match, {r('u.least', 4)} AS group_fairness,
    {r('p.quality', 4)} AS attraction_quality, w.weather_suitability, {r(f'{_shared} + (1 - {_shared}) * (1e0 - p.sens)', 4)} AS seasonal_suitability,
    {r(f'greatest(0e0, least(1e0, {_acc4}))', 4)} AS accessibility_suitability,
    CASE WHEN p.budget IS NULL OR p.fee_min + p.fee_max <= 0 THEN 1e0 ELSE {r('greatest(0e0, 1e0 - least(1e0, (p.fee_min + p.fee_max) / 2e0 / greatest(150e0, p.budget / p.days * 0.45e0)))', 4)} END AS budget_suitability,
    e.evidence AS evidence_quality, {r('least(1e0, p.km / x.max_km)', 4)} AS distance_penalty, {sql_lookup(K.CROWD_PENALTY_SCORING, 'p.crowd', 0.3)} AS crowd_penalty
  FROM v_pairs p JOIN v_rules u ON u.trip = p.trip AND u.place = p.place JOIN v_wscore w ON w.trip = p.trip AND w.place = p.place
  JOIN v_trip_months m ON m.trip = p.trip JOIN v_evidence e ON e.place = p.place JOIN (SELECT trip, max(km) AS max_km FROM v_pairs GROUP BY 1) x ON x.trip = p.trip"""
TOTAL_SQL = " + ".join(f"{w}e0 * {c}" for c, w in K.SCORE_WEIGHTS.items()) + "".join(f" - {w}e0 * {c}" for c, w in K.SCORE_PENALTIES.items())
VIEWS["v_scored"] = f"SELECT c.*, q.reasons, {r(f'{TOTAL_SQL} + mandatory::INT', 6)} AS total FROM v_components c JOIN v_reasons q ON q.trip = c.trip AND q.place = c.place"
PARTS = list(K.SCORE_WEIGHTS) + list(K.SCORE_PENALTIES)


@query("G8_eligibility", "SELECT trip, place, reasons FROM v_reasons")
def g8(spark, root):
    found = G.eligibility(V.trips(spark, root), V.members(spark, root), V.places(spark, root))
    return found.select("trip", "place", F.array_join("reasons", "|").alias("reasons"))


@query("G10_component_scores", "SELECT trip, place, " + ", ".join(PARTS) + " FROM v_components")
def g10(spark, root):
    return scored(spark, root).select("trip", "place", *PARTS)


@query("G11_total_score", "SELECT trip, place, total, mandatory, reasons = '' OR mandatory AS kept FROM v_scored")
def g11(spark, root):
    return scored(spark, root).select("trip", "place", "total", "mandatory", ((F.size("reasons") == 0) | F.col("mandatory")).alias("kept"))


def ranked_kept(s):
    """Kept places in rank order within their trip; a trip meets one circuit, so ranks stay small."""
    kept = s.where((F.size("reasons") == 0) | F.col("mandatory"))
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("trip").orderBy(F.desc("total"), "place")))


VIEWS["v_kept"] = "SELECT *, row_number() OVER (PARTITION BY trip ORDER BY total DESC, place) AS rank FROM v_scored WHERE reasons = '' OR mandatory"


@query("W5_candidate_rank", "SELECT trip, place, rank FROM v_kept")
def w5(spark, root):
    return ranked_kept(scored(spark, root)).select("trip", "place", "rank")


@query("K6_shortlist", "SELECT trip, place, pos FROM (SELECT trip, place, mandatory, row_number() OVER (PARTITION BY trip ORDER BY mandatory DESC, total DESC, place) AS pos, greatest(9, 3 * days) * days AS most FROM v_kept) WHERE pos <= most OR mandatory")
def k6(spark, root):
    """Mandatory places, then the best: at least nine, or three a day, for each day of the trip."""
    kept = scored(spark, root).where((F.size("reasons") == 0) | F.col("mandatory")).select("trip", "place", "mandatory", "total", "days")
    order = W.partitionBy("trip").orderBy(F.desc("mandatory"), F.desc("total"), "place")
    most = F.greatest(F.lit(9), 3 * F.col("days")) * F.col("days")
    return kept.withColumn("pos", F.row_number().over(order)).where((F.col("pos") <= most) | F.col("mandatory")).select("trip", "place", "pos")


LABELS = {
    "interest_match": "stated interests", "group_fairness": "fairness across members", "weather_suitability": "the forecast",
    "seasonal_suitability": "the travel month", "accessibility_suitability": "accessibility", "attraction_quality": "overall quality",
    "budget_suitability": "the budget",
}


@query("R15_stored_explanation", "SELECT k.trip, k.place, 'ranked #' || k.rank || ': ' || t.top || CASE WHEN k.distance_penalty > 0.6e0 THEN '; far from base' ELSE '' END || CASE WHEN k.crowd_penalty > 0.6e0 THEN '; crowded' ELSE '' END || '; total=' || CAST(CAST(floor(k.total * 100 + 0.5e0) AS BIGINT) AS VARCHAR) AS reason FROM v_kept k JOIN (SELECT trip, place, string_agg(name || '=' || CAST(CAST(floor(v * 100 + 0.5e0) AS BIGINT) AS VARCHAR), ', ' ORDER BY v DESC, name) AS top FROM (SELECT *, row_number() OVER (PARTITION BY trip, place ORDER BY v DESC, name) AS rn FROM ("
    + " UNION ALL ".join(f"SELECT trip, place, '{label}' AS name, {c} AS v FROM v_components" for c, label in LABELS.items()) + ")) WHERE rn <= 3 GROUP BY trip, place) t ON t.trip = k.trip AND t.place = k.place")
def r15(spark, root):
    entries = F.array(*[F.struct((-F.col(c)).alias("v"), F.lit(label).alias("name")) for c, label in LABELS.items()])
    note = lambda c, label: F.when(F.col(c) > 0.6, F.lit(label)).otherwise(F.lit(""))
    return ranked_kept(scored(spark, root)).select(
        "trip", "place",
        F.concat(F.lit("ranked #"), F.col("rank").cast("string"), F.lit(": "), top_components(entries), note("distance_penalty", "; far from base"), note("crowd_penalty", "; crowded"),
                 F.lit("; total="), F.floor(F.col("total") * 100 + 0.5).cast("string")).alias("reason"),
    )


@query("F15_explanation", """
  WITH b AS (SELECT trip, place, arg_min(member, (1 - u) * 1e9 + member) AS best_member, max(u) AS best, count(*) AS n FROM v_utility GROUP BY ALL),
  i AS (SELECT place, string_agg(interest, ' and ' ORDER BY weight DESC, pos) AS named FROM (SELECT i.place, i.interest, i.weight, n.pos, row_number() OVER (PARTITION BY i.place ORDER BY i.weight DESC, n.pos) AS rn FROM v_place_interest i JOIN v_interests n ON n.interest = i.interest) WHERE rn <= 2 AND weight > 0.4e0 GROUP BY place)
  SELECT c.trip, c.place, CASE WHEN c.mandatory THEN 'on the must-visit list' ELSE coalesce(nullif(array_to_string(list_filter([
    CASE WHEN i.named IS NOT NULL AND c.interest_match >= 0.4e0 THEN 'matches interest in ' || i.named END, CASE WHEN b.best >= 0.6e0 AND b.n > 1 THEN 'a top pick for member' || b.best_member END,
    CASE WHEN c.group_fairness >= 0.45e0 THEN 'works for everyone' END,
    CASE WHEN c.weather_suitability >= 0.85e0 AND c.kind <> 'indoor' THEN 'the forecast suits it' WHEN c.weather_suitability < 0.55e0 THEN 'mixed forecast' END,
    CASE WHEN c.kind = 'indoor' AND c.weather_suitability >= 0.9e0 THEN 'indoor' END, CASE WHEN c.attraction_quality >= 0.85e0 THEN 'highly rated' END,
    CASE WHEN c.accessibility_suitability >= 0.8e0 THEN 'comfortable for everyone' WHEN c.accessibility_suitability < 0.45e0 THEN 'physically demanding' END,
    CASE WHEN c.crowd_penalty >= 0.65e0 THEN 'expect crowds' END, CASE WHEN c.distance_penalty <= 0.25e0 THEN 'close to base' END], lambda x: x IS NOT NULL)[1:4], '; '), ''), 'a balanced choice') END AS why
  FROM v_components c JOIN b ON b.trip = c.trip AND b.place = c.place LEFT JOIN i ON i.place = c.place""")
def f15(spark, root):
    s = scored(spark, root)
    best = grid(spark, root).groupBy("trip", "place").agg(
        F.min_by("member", F.struct(-F.col("u"), "member")).alias("best_member"), F.max("u").alias("best"), F.count("*").alias("n")
    )
    strengths = F.array(*[F.struct((-v).alias("v"), F.lit(i).alias("pos"), F.lit(name).alias("name")) for i, (name, v) in enumerate(zip(K.INTERESTS, S.interest_vector()))])
    named = F.filter(F.slice(F.array_sort(strengths), 1, 2), lambda e: e["v"] < -0.4)
    rows = s.join(best, ["trip", "place"]).withColumn("named", named)
    wx, acc = F.col("weather_suitability"), F.col("accessibility_suitability")
    outdoors = (wx >= 0.85) & (F.col("kind") != "indoor")
    parts = message_list([
        ((F.size("named") > 0) & (F.col("interest_match") >= 0.4), F.concat(F.lit("matches interest in "), F.array_join(F.transform("named", lambda e: e["name"]), " and "))),
        ((F.col("best") >= 0.6) & (F.col("n") > 1), F.concat(F.lit("a top pick for member"), F.col("best_member").cast("string"))),
        (F.col("group_fairness") >= 0.45, F.lit("works for everyone")),
        (outdoors, F.lit("the forecast suits it")),
        (~outdoors & (wx < 0.55), F.lit("mixed forecast")),
        ((F.col("kind") == "indoor") & (wx >= 0.9), F.lit("indoor")),
        (F.col("attraction_quality") >= 0.85, F.lit("highly rated")),
        (acc >= 0.8, F.lit("comfortable for everyone")),
        (acc < 0.45, F.lit("physically demanding")),
        (F.col("crowd_penalty") >= 0.65, F.lit("expect crowds")),
        (F.col("distance_penalty") <= 0.25, F.lit("close to base")),
    ])
    sentence = F.array_join(F.slice(parts, 1, 4), "; ")
    why = F.when(F.col("mandatory"), "on the must-visit list").when(sentence == "", "a balanced choice").otherwise(sentence)
    return rows.select("trip", "place", why.alias("why"))


# ------------------------------------------------------------------ iterative selection
VIEWS["v_pool"] = "SELECT k.trip, k.place, k.mandatory, k.total / (SELECT max(abs(total)) FROM v_kept x WHERE x.trip = k.trip) AS score FROM v_kept k"
VIEWS["v_pick0"] = "SELECT trip, place, 0 AS step FROM v_pool WHERE mandatory"
ROUNDS = 3
for _n in range(1, ROUNDS + 1):
    VIEWS[f"v_pick{_n}"] = f"""
      WITH trial AS (
        SELECT u.trip, u.place AS candidate, u.member, u.must_places, u.u FROM v_utility u JOIN v_pool p ON p.trip = u.trip AND p.place = u.place
          WHERE NOT EXISTS (SELECT 1 FROM v_pick{_n - 1} c WHERE c.trip = u.trip AND c.place = u.place)
            AND (SELECT count(*) FROM v_pick{_n - 1} c WHERE c.trip = u.trip) < {ROUNDS}),
      bag AS (
        SELECT trip, candidate, member, must_places, candidate AS place, u FROM trial
        UNION ALL SELECT t.trip, t.candidate, t.member, t.must_places, c.place, u.u FROM trial t JOIN v_pick{_n - 1} c ON c.trip = t.trip JOIN v_utility u ON u.trip = t.trip AND u.member = t.member AND u.place = c.place),
      cov AS ({COVERAGE.format(keys='trip, candidate', src='SELECT * FROM bag')}),
      obj AS (SELECT trip, candidate, 0.65e0 * {r('avg(value)', 6)} + 0.35e0 * min(value) AS objective FROM cov GROUP BY trip, candidate),
      best AS (SELECT o.trip, o.candidate, row_number() OVER (PARTITION BY o.trip ORDER BY {r('0.65e0 * o.objective + 0.35e0 * p.score', 9)} DESC, o.candidate) AS rn
        FROM obj o JOIN v_pool p ON p.trip = o.trip AND p.place = o.candidate)
      SELECT * FROM v_pick{_n - 1} UNION ALL SELECT trip, candidate, {_n} FROM best WHERE rn = 1"""


@query("G7_iterative_selection", f"SELECT trip, place, step FROM v_pick{ROUNDS}")
def g7(spark, root):
    kept = ranked_kept(scored(spark, root)).select("trip", "place", "total", "mandatory")
    return G.select_fairly(grid(spark, root), kept, ROUNDS)


# one step of the recursion is one pick of every trip, until all places are picked
VIEWS["v_voted"] = """
  SELECT u.trip, u.member, any_value(u.must_places) AS musts, list({'place': u.place, 'u': u.u}) AS us
  FROM v_utility u JOIN v_pool p ON p.trip = u.trip AND p.place = u.place GROUP BY u.trip, u.member"""
VIEWS["v_picks"] = f"""
  WITH RECURSIVE f AS (
    SELECT trip, coalesce(list(place) FILTER (mandatory), []) AS picked, 0 AS step, NULL::BIGINT AS place FROM v_pool GROUP BY trip
    UNION ALL
    SELECT trip, list_append(any_value(picked), first(candidate ORDER BY worth DESC, candidate)), any_value(step) + 1, first(candidate ORDER BY worth DESC, candidate) FROM (
      SELECT trip, candidate, any_value(picked) AS picked, any_value(step) AS step,
        {r(f"0.65e0 * (0.65e0 * {r('avg(value)', 6)} + 0.35e0 * min(value)) + 0.35e0 * any_value(score)", 9)} AS worth FROM (
        SELECT *, {r('least(1e0, CASE WHEN len(musts) > 0 THEN 0.7e0 * top_mean + 0.3e0 * (honoured / CAST(len(musts) AS DOUBLE)) ELSE top_mean END)', 6)} AS value FROM (
          SELECT f.trip, f.picked, f.step, p.place AS candidate, p.score, v.musts,
            list_avg(list_sort(list_transform(list_filter(v.us, lambda x: x.place = p.place OR list_contains(f.picked, x.place)), lambda x: x.u), 'DESC')[1:5]) AS top_mean,
            len(list_filter(v.musts, lambda x: x = p.place OR list_contains(f.picked, x))) AS honoured
          FROM f JOIN v_pool p ON p.trip = f.trip AND NOT list_contains(f.picked, p.place) JOIN v_voted v ON v.trip = f.trip)) GROUP BY trip, candidate) GROUP BY trip)
  SELECT trip, place, step FROM f WHERE step > 0 UNION ALL SELECT trip, place, 0 FROM v_pool WHERE mandatory"""
METHODS = ["simple", "weighted", "borda", "least", "fair"]
VIEWS["v_methods"] = """
  SELECT k.trip, k.place, k.mandatory, k.total - 0.3e0 * k.interest_match AS rest, r.simple, r.weighted, r.least, r.fair, b.borda FROM v_kept k
  JOIN v_rules r ON r.trip = k.trip AND r.place = k.place JOIN v_borda b ON b.trip = k.trip AND b.place = k.place"""
_ranked = " UNION ALL ".join(
    f"SELECT '{m}' AS method, trip, place, row_number() OVER (PARTITION BY trip ORDER BY {r(f'rest + 0.3e0 * round(least(1e0, {m}) + 1e-9, 4)', 6)} DESC, place) AS rn FROM v_methods" for m in METHODS
)
VIEWS["v_selections"] = f"""
  SELECT r.method, k.k, r.trip, r.place FROM ({_ranked}) r JOIN (SELECT unnest([5, 8, 12]) AS k) k ON r.rn <= k.k
  UNION ALL SELECT 'iterative', k.k, p.trip, p.place FROM (SELECT *, count(*) FILTER (step = 0) OVER (PARTITION BY trip) AS given FROM v_picks) p
    JOIN (SELECT unnest([5, 8, 12]) AS k) k ON p.step = 0 OR p.given + p.step <= k.k"""


@query("G13_method_comparison", f"""
  WITH c AS ({COVERAGE.format(keys='method, k, trip', src='SELECT s.method, s.k, u.* FROM v_utility u JOIN v_selections s ON s.trip = u.trip AND s.place = u.place')}),
  g AS (SELECT method, k, trip, {SATISFIED} FROM c GROUP BY method, k, trip),
  d AS ({DEMAND}), v AS (SELECT s.method, s.k, s.trip, i.interest, max(i.weight) AS supply FROM v_selections s JOIN v_place_interest i ON i.place = s.place GROUP BY ALL),
  n AS (SELECT g.method, g.k, g.trip, count(*) FILTER (coalesce(v.supply, 0e0) >= 0.5e0) / CAST(greatest(1, count(*)) AS DOUBLE) AS covered FROM g JOIN d ON d.trip = g.trip AND d.demand > 0.35e0
    LEFT JOIN v ON v.method = g.method AND v.k = g.k AND v.trip = g.trip AND v.interest = d.interest GROUP BY ALL),
  m AS (SELECT g.method, g.k, {r('avg(g.mean)', 4)} AS mean, {r('avg(g.least)', 4)} AS least, {r('avg(g.jain)', 4)} AS jain, {r('avg(g.consensus)', 4)} AS consensus, {r('avg(g.spread)', 4)} AS spread,
    {r('avg(n.covered)', 4)} AS interests_covered FROM g LEFT JOIN n ON n.method = g.method AND n.k = g.k AND n.trip = g.trip GROUP BY g.method, g.k)
  SELECT m.*, {r('100 * (m.least - b.least) / nullif(b.least, 0)', 2)} AS floor_gain, {r('100 * (b.mean - m.mean) / nullif(b.mean, 0)', 2)} AS mean_cost,
    {r('100 * (b.spread - m.spread) / nullif(b.spread, 0)', 2)} AS spread_cut FROM m JOIN m b ON b.k = m.k AND b.method = 'simple'""")
def g13(spark, root):
    """Six methods at three sizes, and what each gains and costs against the plain average."""
    g = cut(grid(spark, root), "grid")
    kept = cut(ranked_kept(scored(spark, root)).select(
        "trip", "place", "total", "mandatory", (F.col("total") - 0.3 * F.col("interest_match")).alias("rest")
    ), "kept")
    rules = kept.join(G.aggregated(g), ["trip", "place"]).join(G.borda(g), ["trip", "place"])
    by_method = F.array(*[F.struct(F.lit(m).alias("method"), rnd(F.col("rest") + 0.3 * rnd(F.least(F.lit(1.0), F.col(m)), 4), 6).alias("score")) for m in METHODS])
    top = grouped.top_n(rules.select("trip", "place", F.inline(by_method)), ["method", "trip"], [F.desc("score"), F.col("place")], 12, "rn")
    sizes = F.explode(F.array(F.lit(5), F.lit(8), F.lit(12)))
    one_pass = top.withColumn("k", sizes).where("rn <= k").select("method", "k", "trip", "place")
    in_turn = G.chosen_first(G.select_fairly(g, kept, 12).withColumn("k", sizes), F.col("k"))
    selections = cut(one_pass.unionByName(in_turn.select(F.lit("iterative").alias("method"), "k", "trip", "place")), "selections")
    keys = ["method", "k", "trip"]
    metrics = G.satisfaction(G.member_coverage(g, selections, keys), keys)
    joined = V.members(spark, root).join(V.trips(spark, root).select("trip"), "trip")
    covered = interest_coverage(joined, selections, V.places(spark, root), keys).groupBy(*keys).agg(
        (F.count_if(F.col("covered") >= 0.5) / F.count("*")).alias("covered")
    )
    mean = lambda c, name=None: rnd(F.avg(c), 4).alias(name or c)
    means = cut(metrics.join(covered, keys, "left").groupBy("method", "k").agg(
        *[mean(c) for c in ("mean", "least", "jain", "consensus", "spread")], mean("covered", "interests_covered")
    ), "means")
    plain = means.where("method = 'simple'").select("k", *[F.col(c).alias(f"plain_{c}") for c in ("mean", "least", "spread")])
    share = lambda c, sign: rnd(sign * 100 * F.try_divide(F.col(c) - F.col(f"plain_{c}"), F.col(f"plain_{c}")), 2)
    return means.join(plain, "k").select(
        *means.columns, share("least", 1).alias("floor_gain"), share("mean", -1).alias("mean_cost"), share("spread", -1).alias("spread_cut")
    )


def shortlist(spark, root):
    """(trip, place, pos, total, days): picks in turn where several travel together, else the best by total."""
    kept = cut(ranked_kept(scored(spark, root)).select("trip", "place", "total", "mandatory", "days"), "kept")
    kept = kept.withColumn("most", F.greatest(F.lit(9), 3 * F.col("days")) * F.col("days"))
    together = V.members(spark, root).where("status <> 'opted_out'").groupBy("trip").agg((F.count("*") > 1).alias("together"))
    picks = G.select_fairly(grid(spark, root), kept, "most").select("trip", "place", "step")
    turn = F.when(F.col("together"), F.col("step")).otherwise(1 - F.col("mandatory").cast("int"))
    order = W.partitionBy("trip").orderBy(turn, F.desc("total"), "place")
    # picks stop at the size of the list, so places without a turn come last
    ranked = kept.join(together, "trip").join(picks, ["trip", "place"], "left").where("not together or step is not null").withColumn("pos", F.row_number().over(order))
    return ranked.where((F.col("pos") <= F.col("most")) | F.col("mandatory")).select("trip", "place", "pos", "total", "days")


VIEWS["v_fair_shortlist"] = """
  SELECT trip, place, pos, total, days FROM (
    SELECT k.*, greatest(9, 3 * k.days) * k.days AS most, row_number() OVER (PARTITION BY k.trip ORDER BY CASE WHEN m.n > 1 THEN p.step ELSE 1 - k.mandatory::INT END, k.total DESC, k.place) AS pos
    FROM v_kept k JOIN v_picks p ON p.trip = k.trip AND p.place = k.place JOIN (SELECT trip, count(*) AS n FROM v_members WHERE status <> 'opted_out' GROUP BY trip) m ON m.trip = k.trip)
  WHERE pos <= most OR mandatory"""


@query("K6_fair_shortlist", "SELECT trip, place, pos FROM v_fair_shortlist")
def k6b(spark, root):
    return shortlist(spark, root).select("trip", "place", "pos")


# ------------------------------------------------------------------ day clusters and day filling
def cluster_views(tag, source):
    """SQL of seeds, rounds and balancing over ``source`` (trip, place, lat, lon, days, score), under names ending in ``tag``."""
    VIEWS[f"v_xy{tag}"] = f"""
      SELECT g.trip, g.place, g.score, g.lat * 111.32e0 AS x, g.lon * 111.32e0 * cos(radians(m.ref)) AS y, least(g.days, m.n) AS k FROM ({source}) g
      JOIN (SELECT trip, avg(lat) AS ref, count(*) AS n FROM ({source}) GROUP BY 1) m ON m.trip = g.trip"""
    VIEWS[f"v_seed1{tag}"] = f"SELECT trip, 0 AS c, place, x, y FROM (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY score DESC, place) AS rn FROM v_xy{tag}) WHERE rn = 1"
    for n in range(2, 6):
        VIEWS[f"v_seed{n}{tag}"] = f"""
          SELECT * FROM v_seed{n - 1}{tag} UNION ALL SELECT trip, {n - 1}, place, x, y FROM (
            SELECT p.trip, p.place, p.x, p.y, row_number() OVER (PARTITION BY p.trip ORDER BY round(min(sqrt(pow(p.x - s.x, 2) + pow(p.y - s.y, 2))), 6) DESC, p.place) AS rn
            FROM v_xy{tag} p JOIN v_seed{n - 1}{tag} s ON s.trip = p.trip WHERE p.k >= {n} AND NOT EXISTS (SELECT 1 FROM v_seed{n - 1}{tag} z WHERE z.trip = p.trip AND z.place = p.place)
            GROUP BY p.trip, p.place, p.x, p.y) WHERE rn = 1"""
    far = "round(sqrt(pow(p.x - c.x, 2) + pow(p.y - c.y, 2)), 6)"
    own = "list_filter(pts, lambda p, j: g[j] = i - 1)"
    VIEWS[f"v_rounds{tag}"] = f"""
      WITH RECURSIVE f AS (
        SELECT p.trip, 0 AS step, p.pts, c.cents, list_transform(p.pts, lambda p: 0::BIGINT) AS g, true AS moving
        FROM (SELECT trip, list({{'place': place, 'x': x, 'y': y}} ORDER BY place) AS pts FROM v_xy{tag} GROUP BY trip) p
        JOIN (SELECT trip, list({{'x': x, 'y': y}} ORDER BY c) AS cents FROM v_seed5{tag} GROUP BY trip) c ON c.trip = p.trip
        UNION ALL
        SELECT trip, step + 1, pts, list_transform(cents, lambda s, i: CASE WHEN len({own}) = 0 THEN s
          ELSE {{'x': list_sum(list_transform({own}, lambda p: p.x)) / len({own}), 'y': list_sum(list_transform({own}, lambda p: p.y)) / len({own})}} END), g, g <> was FROM (
          SELECT trip, step, pts, cents, g AS was,
            list_transform(pts, lambda p: (list_position(list_transform(cents, lambda c: {far}), list_min(list_transform(cents, lambda c: {far}))) - 1)::BIGINT) AS g
          FROM f WHERE moving AND step < 60))
      SELECT trip, pts, cents, g FROM (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY step DESC) AS rn FROM f) WHERE rn = 1"""
    # a step of this recursion moves one place of every trip that still has an over-full and an under-full group
    VIEWS[f"v_moves{tag}"] = f"""
      WITH RECURSIVE f AS (
        SELECT trip, 0 AS step, pts, cents, g FROM v_rounds{tag}
        UNION ALL
        SELECT trip, step + 1, pts, cents, list_transform(g, lambda c, j: CASE WHEN j = best.j THEN target ELSE c END) FROM (
          SELECT *, list_min(list_filter(list_transform(pts, lambda p, j: CASE WHEN g[j] = source THEN
            {{'extra': round(sqrt(pow(p.x - cents[target + 1].x, 2) + pow(p.y - cents[target + 1].y, 2)), 6) - round(sqrt(pow(p.x - cents[source + 1].x, 2) + pow(p.y - cents[source + 1].y, 2)), 6), 'j': j}} END), lambda e: e IS NOT NULL)) AS best FROM (
            SELECT *, list_position(sizes, list_max(list_filter(sizes, lambda s: s > ceil(n / k * 1.4e0)))) - 1 AS source,
              list_position(sizes, list_min(list_filter(sizes, lambda s: s < greatest(1, floor(n / k * 0.5e0))))) - 1 AS target FROM (
              SELECT *, CAST(len(pts) AS DOUBLE) AS n, len(cents) AS k, list_transform(cents, lambda s, i: len(list_filter(g, lambda c: c = i - 1))) AS sizes FROM f WHERE step < len(pts)))
          WHERE source IS NOT NULL AND target IS NOT NULL)
        WHERE best.extra <= {K.BALANCE_MOVE_KM}e0)
      SELECT trip, pts, cents, g FROM (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY step DESC) AS rn FROM f) WHERE rn = 1"""


def clusters_sql(view):
    return f"""
      SELECT a.trip, a.place, CAST(a.c AS INT) AS c, CAST(s.day AS INT) AS day FROM (SELECT trip, unnest(pts).place AS place, unnest(g) AS c FROM {view}) a JOIN (
        SELECT trip, c, row_number() OVER (PARTITION BY trip ORDER BY count(*) DESC, c) - 1 AS day FROM (SELECT trip, unnest(g) AS c FROM {view}) GROUP BY trip, c) s ON s.trip = a.trip AND s.c = a.c"""


cluster_views("", "SELECT trip, place, lat, lon, days, quality AS score FROM v_groups")
cluster_views("_s", "SELECT s.trip, s.place, p.lat, p.lon, s.days, s.total AS score FROM v_fair_shortlist s JOIN v_places p ON p.place = s.place")


@query("G12_day_clusters", clusters_sql("v_rounds"))
def g12(spark, root):
    """All places of a trip's circuit, in rounds until no place changes its group."""
    trips = V.trips(spark, root).select("trip", "circuit", "days")
    items = trips.join(V.places(spark, root).select("place", "circuit", "lat", "lon", F.col("quality").alias("score")), "circuit")
    return D.day_clusters(items)


@query("G12_balanced_day_clusters", clusters_sql("v_moves_s"))
def g12b(spark, root):
    """The shortlist of a trip, in rounds and then balanced."""
    items = shortlist(spark, root).join(V.places(spark, root).select("place", "lat", "lon"), "place")
    return D.day_clusters(items.withColumnRenamed("total", "score"), balanced=True)


@query("G12_balanced_circuits", clusters_sql("v_moves"))
def g12c(spark, root):
    """All places of a trip's circuit, in rounds and then balanced."""
    trips = V.trips(spark, root).select("trip", "circuit", "days")
    items = trips.join(V.places(spark, root).select("place", "circuit", "lat", "lon", F.col("quality").alias("score")), "circuit")
    return D.day_clusters(items, balanced=True)


_BEST = "row_number() OVER (PARTITION BY k.trip, k.place ORDER BY least(w.closes, t.day_end) - greatest(w.opens, t.day_start) DESC, w.opens) AS wr"
VIEWS["v_fill"] = f"""
  SELECT *, row_number() OVER (PARTITION BY trip, day ORDER BY mandatory DESC, total DESC, place) AS rn FROM (
    SELECT *, row_number() OVER (PARTITION BY trip, day ORDER BY total DESC, place) AS pr FROM (
      SELECT k.trip, k.place, CAST(k.place % t.days AS INT) AS day, k.mandatory, k.total, p.lat, p.lon, p.fee_max AS fee, t.mode, t.base_lat, t.base_lon, t.day_start, t.day_end, t.pace,
        CASE t.pace WHEN 'packed' THEN greatest(p.min_dur, CAST(floor(p.typ * 0.8e0) AS INT)) WHEN 'relaxed' THEN least(p.max_dur, CAST(floor(p.typ * 1.15e0) AS INT)) ELSE p.typ END AS service,
        CASE WHEN t.budget IS NOT NULL THEN greatest(200e0, t.budget / t.days * 0.45e0) END AS fee_budget, t.start_date
      FROM v_kept k JOIN v_trips t ON t.trip = k.trip JOIN v_places p ON p.place = k.place)) WHERE pr <= {K.DAY_POOL}"""
VIEWS["v_fill_windows"] = """
  SELECT trip, place, arg_max(e, (l - e) * 100000 - o) AS earliest, arg_max(l, (l - e) * 100000 - o) AS latest FROM (
    SELECT f.trip, f.place, w.opens AS o, greatest(w.opens, f.day_start) AS e, least(w.closes, f.day_end) - f.service AS l
    FROM v_fill f JOIN v_windows w ON w.place = f.place AND w.wd = isodow(f.start_date + f.day) - 1) WHERE l >= e GROUP BY trip, place"""


def _hop(lat1, lon1, lat2, lon2, mode):
    from waymark.plans.shaping import leg_sql

    km, minutes = leg_sql(lat1, lon1, lat2, lon2, mode)
    return km, f"CAST(round_even({minutes}, 0) AS INT)"


_hk, _hm = _hop("s.la", "s.lo", "f.lat", "f.lon", "f.mode")
_bk, _bm = _hop("s.la", "s.lo", "h.base_lat", "h.base_lon", "h.mode")


@query("G9_day_fill", f"""
  WITH RECURSIVE items AS MATERIALIZED (SELECT f.*, w.earliest, w.latest, CASE pace WHEN 'relaxed' THEN 3 WHEN 'packed' THEN 6 ELSE 4 END AS max_stops,
      CASE pace WHEN 'relaxed' THEN 150 WHEN 'packed' THEN 300 ELSE 210 END AS max_travel FROM v_fill f LEFT JOIN v_fill_windows w ON w.trip = f.trip AND w.place = f.place),
  st AS (
    SELECT trip, day, CAST(1 AS BIGINT) AS rn, day_start AS clock, base_lat AS la, base_lon AS lo, 0e0 AS km, 0 AS minutes, 0e0 AS spent, 0 AS n, false AS meal, '' AS log FROM items WHERE rn = 1
    UNION ALL
    SELECT trip, day, rn + 1, CAST(CASE WHEN t THEN begin + service ELSE c2 END AS INT), CASE WHEN t THEN lat ELSE la END, CASE WHEN t THEN lon ELSE lo END, CASE WHEN t THEN km + hk ELSE km END,
      CAST(CASE WHEN t THEN m2 + hm ELSE m2 END AS INT), CASE WHEN t THEN spent + fee ELSE spent END, CASE WHEN t THEN n + 1 ELSE n END, meal OR eats,
      CASE WHEN t THEN log || CASE WHEN n > 0 THEN ',' ELSE '' END || place || '@' || begin ELSE log END
    FROM (SELECT *, reach AND begin <= latest AND begin + service <= day_end AND (mandatory OR fee_budget IS NULL OR spent + fee <= fee_budget) AS t FROM (
      SELECT *, greatest(c2 + hm, earliest) AS begin FROM (
        SELECT *, CASE WHEN eats THEN greatest(clock + 5, 720) + 50 ELSE clock END AS c2, CASE WHEN eats THEN minutes + 5 ELSE minutes END AS m2 FROM (
          SELECT *, reach AND NOT meal AND clock + hm >= 720 AND greatest(clock + 5, 720) + 50 <= least(920, day_end) AS eats FROM (
            SELECT *, n < max_stops AND earliest IS NOT NULL AND minutes + hm <= max_travel AS reach FROM (
              SELECT s.trip, s.day, s.rn, s.clock, s.la, s.lo, s.km, s.minutes, s.spent, s.n, s.meal, s.log, f.place, f.lat, f.lon, f.fee, f.service, f.earliest, f.latest, f.mandatory, f.fee_budget, f.day_end, f.max_stops, f.max_travel,
                {_hk} AS hk, {_hm} AS hm FROM st s JOIN items f ON f.trip = s.trip AND f.day = s.day AND f.rn = s.rn))))))),
  last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trip, day ORDER BY rn DESC) AS z FROM st) WHERE z = 1)
  SELECT s.trip, s.day, CAST(s.n AS BIGINT) AS stops, {r(f'CASE WHEN s.n > 0 THEN s.km + {_bk} ELSE s.km END', 3)} AS km, CAST(CASE WHEN s.n > 0 THEN s.minutes + {_bm} ELSE s.minutes END AS BIGINT) AS minutes,
    {r('s.spent', 2)} AS spent, s.meal OR greatest(s.clock + 5, 720) + 50 <= h.day_end AS meal, s.log AS schedule
  FROM last s JOIN items h ON h.trip = s.trip AND h.day = s.day AND h.rn = 1""")
def g9(spark, root):
    from waymark.functions import clock
    from waymark.functions.stats import lookup

    kept = scored(spark, root).where((F.size("reasons") == 0) | F.col("mandatory")).withColumn("day", F.expr("cast(place % days as int)"))
    pool = grouped.top_n(kept, ["trip", "day"], [F.desc("total"), F.col("place")], K.DAY_POOL, "pr")
    service = clock.visit_minutes(F.col("pace"), F.col("typ"), F.col("min_dur"), F.col("max_dur"))
    wd = F.weekday(F.date_add("start_date", F.col("day")))
    span = clock.widest_start(clock.open_windows(F.col("windows"), F.col("closed_dow"), wd), F.col("day_start"), F.col("day_end"), F.col("service"))
    stop = F.struct(
        (~F.col("mandatory")).alias("later"), (-F.col("total")).alias("o"), "place", "lat", "lon", "service",
        F.col("span.earliest").alias("earliest"), F.col("span.latest").alias("latest"), F.col("fee_max").alias("fee"), "mandatory",
    )
    keys = ["trip", "day", "base_lat", "base_lon", "mode", "pace", "day_start", "day_end", "budget", "days"]
    days = pool.withColumn("service", service).withColumn("span", span).groupBy(*keys).agg(F.array_sort(F.collect_list(stop)).alias("stops"))
    limited = days.withColumns({
        "max_stops": lookup(K.PACE_MAX_ACTIVITIES, F.col("pace"), 4), "max_travel": lookup(K.PACE_MAX_TRAVEL_MIN, F.col("pace"), 210),
        "fee_budget": F.when(F.col("budget").isNotNull(), F.greatest(F.lit(200.0), F.col("budget") / F.col("days") * 0.45)),
    })
    return limited.select("trip", "day", D.fill_day().alias("f")).select("trip", "day", "f.*")
