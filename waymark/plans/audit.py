"""Queries: plan auditing, cost ranges, plan metrics and paired comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import constants as K
from waymark.functions.stats import rnd
from waymark.operators import audit as A, grouped
from waymark.plans.registry import query
from waymark.plans.view_sql import VIEWS, rnd as r, sql_lookup
from waymark.plans.windows import duplicate_visits, with_previous
from waymark.session import cut, work_path
from waymark.sources import catalogue, views as V


def dated_stops(spark, root, acts=None):
    """Activities with the accessibility need, the dates and the day window of their trip."""
    t = V.trips(spark, root).select(F.col("trip").alias("plan"), "needs_access", "start_date", "day_start", "day_end")
    return (V.activities(spark, root) if acts is None else acts).join(t, "plan")


def with_attributes(stops, places):
    """Adds place attributes; unknown places stay. Never by broadcast: a catalogue's files are far smaller than its rows."""
    return stops.join(places.select("place", "typ", "min_dur", "max_dur", "access", F.col("kind").alias("exposure")).hint("merge"), "place", "left")


def with_openings(stops, places):
    """Adds place attributes and the open intervals of the weekday; unknown places stay.

    Never by broadcast: the planner takes the seven rows per place for a part of the catalogue's compressed file.
    """
    attributes = places.select("place", "typ", "min_dur", "max_dur", "access", F.col("kind").alias("exposure"))
    dated = stops.withColumn("wd", F.weekday(F.date_add("start_date", F.col("day"))))
    opened = A.open_by_weekday(places).hint("merge").join(attributes, "place")
    return dated.join(opened.hint("merge"), ["place", "wd"], "left")


def audited_stops(spark, root):
    """Activities with predecessor, trip and place attributes: what all checks together look at."""
    return with_openings(dated_stops(spark, root, with_previous(V.activities(spark, root))), V.places(spark, root))


def issues_of(stops, group):
    return A.stop_issues(stops, *codes(group)).select(*A.ISSUE_COLUMNS)


VIEWS["v_aud"] = f"""
  SELECT g.*, t.needs_access, t.pace, t.day_start, t.day_end, CAST(isodow(t.start_date + g.day) - 1 AS INT) AS wd, p.min_dur, p.max_dur, p.access, p.kind AS exposure,
    EXISTS (SELECT 1 FROM v_windows w WHERE w.place = g.place AND w.wd = isodow(t.start_date + g.day) - 1) AS opened,
    EXISTS (SELECT 1 FROM v_windows w WHERE w.place = g.place AND w.wd = isodow(t.start_date + g.day) - 1 AND w.opens <= g.start_min AND g.end_min <= w.closes) AS inside
  FROM v_gaps g JOIN v_trips t ON t.trip = g.plan LEFT JOIN v_places p ON p.place = g.place"""
CHECKS = {
    "C2": [("overlapping_activities", "error", "start_min < prev_end")],
    "C3": [("starts_before_day_window", "error", "start_min < day_start"), ("ends_after_day_window", "error", "end_min > day_end"), ("non_positive_duration", "error", "end_min <= start_min")],
    "C4": [("insufficient_travel_time", "error", "travel_min - (start_min - prev_end) > 2")],
    "C6": [("closed_on_this_day", "error", "kind = 'visit' AND NOT opened"), ("outside_opening_hours", "error", "kind = 'visit' AND opened AND NOT inside")],
    "C7": [("visit_too_short", "error", "kind = 'visit' AND end_min - start_min < min_dur"), ("visit_longer_than_needed", "warning", "kind = 'visit' AND end_min - start_min > max_dur")],
    "C8": [("accessibility_violation", "error", "kind = 'visit' AND needs_access AND access = 'no'"), ("poor_weather_for_outdoor_activity", "warning", "kind = 'visit' AND weather < 0.45e0 AND exposure = 'outdoor'")],
}


def check_sql(group: str, view: str = "v_aud") -> str:
    return " UNION ALL ".join(f"SELECT plan, day, place, '{c}' AS code, '{s}' AS severity FROM {view} WHERE {w}" for c, s, w in CHECKS[group])


def codes(group: str) -> list[str]:
    return [c for c, _, _ in CHECKS[group]]


@query("C1_empty_itinerary", "SELECT trip AS plan FROM v_trips t WHERE NOT EXISTS (SELECT 1 FROM v_acts a WHERE a.plan = t.trip AND a.kind = 'visit')")
def c1(spark, root):
    visits = V.activities(spark, root).where("kind = 'visit'").select(F.col("plan").alias("trip"))
    return V.trips(spark, root).select("trip").join(visits, "trip", "left_anti").select(F.col("trip").alias("plan"))


@query("C2_overlap", check_sql("C2", "v_gaps"))
def c2(spark, root):
    return issues_of(with_previous(V.activities(spark, root)), "C2")


@query("C3_day_window", check_sql("C3"))
def c3(spark, root):
    return issues_of(dated_stops(spark, root), "C3")


@query("C4_travel_time", check_sql("C4", "v_gaps"))
def c4(spark, root):
    return issues_of(with_previous(V.activities(spark, root)), "C4")


VIEWS["v_dups"] = """
  SELECT plan, day, place, 'duplicate_visit' AS code, 'error' AS severity FROM (
    SELECT plan, place, day, row_number() OVER (PARTITION BY plan, place ORDER BY day, start_min) AS rn FROM v_acts WHERE kind = 'visit') WHERE rn > 1"""


def duplicate_issues(acts):
    dups = duplicate_visits(acts.where("kind = 'visit'")).select("plan", "day", "place", F.explode(F.sequence(F.lit(1), F.col("flagged").cast("int"))).alias("i"))
    return dups.select("plan", "day", "place", F.lit("duplicate_visit").alias("code"), F.lit("error").alias("severity"))


@query("C5_duplicate_visit", "SELECT * FROM v_dups")
def c5(spark, root):
    return duplicate_issues(V.activities(spark, root))


@query("C6_opening_hours", check_sql("C6"))
def c6(spark, root):
    return issues_of(with_openings(dated_stops(spark, root), V.places(spark, root)), "C6")


@query("C7_visit_length", check_sql("C7", "(SELECT a.*, p.min_dur, p.max_dur FROM v_acts a JOIN v_places p ON p.place = a.place)"))
def c7(spark, root):
    return issues_of(with_attributes(V.activities(spark, root), V.places(spark, root)), "C7")


@query("C8_access_and_weather", check_sql("C8"))
def c8(spark, root):
    return issues_of(with_attributes(dated_stops(spark, root), V.places(spark, root)), "C8")


VIEWS["v_days"] = "SELECT a.plan, a.day, sum(travel_min) AS travel, count(*) FILTER (kind = 'visit') AS visits, count(*) FILTER (kind = 'meal') AS meals, any_value(t.pace) AS pace, any_value(t.day_end - t.day_start) AS win FROM v_acts a JOIN v_trips t ON t.trip = a.plan GROUP BY a.plan, a.day"
VIEWS["v_day_issues"] = """
  SELECT plan, day, CAST(NULL AS BIGINT) AS place, 'excessive_daily_travel' AS code, 'warning' AS severity FROM v_days WHERE travel > CASE pace WHEN 'relaxed' THEN 150 WHEN 'packed' THEN 300 ELSE 210 END
  UNION ALL SELECT plan, day, NULL, 'too_many_activities', 'warning' FROM v_days WHERE visits > CASE pace WHEN 'relaxed' THEN 3 WHEN 'packed' THEN 6 ELSE 4 END
  UNION ALL SELECT plan, day, NULL, 'no_meal_break', 'warning' FROM v_days WHERE win > 360 AND visits > 0 AND meals = 0"""


@query("C9_day_limits", "SELECT * FROM v_day_issues")
def c9(spark, root):
    return A.day_issues(V.activities(spark, root), V.trips(spark, root))


def required(spark, root):
    """Must-visit places of the members of each trip."""
    m = V.members(spark, root).select("trip", F.explode("must_places").alias("place")).distinct()
    return m.join(V.trips(spark, root).select("trip"), "trip", "left_semi")


VIEWS["v_missing"] = "SELECT DISTINCT m.trip AS plan, m.place FROM (SELECT trip, unnest(must_places) AS place FROM v_members) m JOIN v_trips t ON t.trip = m.trip WHERE NOT EXISTS (SELECT 1 FROM v_acts a WHERE a.plan = m.trip AND a.place = m.place AND a.kind = 'visit')"


@query("C10_missing_mandatory", "SELECT plan, place FROM v_missing")
def c10(spark, root):
    seen = V.activities(spark, root).where("kind = 'visit'").select(F.col("plan").alias("trip"), "place")
    return required(spark, root).join(seen, ["trip", "place"], "left_anti").select(F.col("trip").alias("plan"), "place")


_rate = lambda what: sql_lookup({k: v[what] for k, v in K.BASELINE_RATES.items()}, "t.tier", K.BASELINE_RATES["midrange"][what])
_km = lambda i: sql_lookup({k: v[i] for k, v in K.PER_KM_RATES.items()}, "t.mode", 12.0)
_floor = f"({_rate('local_transport')} * 0.8e0 * t.travellers * t.days * 0.5e0)"
_veh = "greatest(1, (t.travellers + 3) // 4)"
VIEWS["v_cost0"] = f"""
  SELECT t.trip, t.travellers, t.budget, ({_rate('stay')} * ((t.travellers + 1) // 2) * (t.days - 1) + {_rate('food')} * t.travellers * t.days) AS base,
    greatest(coalesce(k.km, 0e0) * {_km(0)} * {_veh}, {_floor}) AS ride_low, greatest(coalesce(k.km, 0e0) * {_km(1)} * {_veh}, {_floor} * 1.6e0) AS ride_high,
    coalesce(f.low, 0e0) * t.travellers AS fee_low, coalesce(f.high, 0e0) * t.travellers AS fee_high, 0.08e0 + 0.01e0 * least(7, t.days) + 0.07e0 * coalesce(f.exposed, 0e0) AS reserve
  FROM v_trips t LEFT JOIN (SELECT plan, sum(travel_km) AS km FROM v_acts GROUP BY 1) k ON k.plan = t.trip
  LEFT JOIN (SELECT a.plan, sum(CASE WHEN fee_max > 0 THEN fee_min END) AS low, sum(CASE WHEN fee_max > 0 THEN fee_max END) AS high, avg((p.kind = 'outdoor')::INT) AS exposed
    FROM v_acts a JOIN v_places p ON p.place = a.place WHERE a.kind = 'visit' GROUP BY 1) f ON f.plan = t.trip"""
_low, _high = "(base * 0.8e0 + ride_low + fee_low) * (1 + reserve * 0.6e0)", "(base * 1.3e0 + ride_high + fee_high) * (1 + reserve)"
VIEWS["v_cost"] = f"SELECT trip, budget, {r(_low, 2)} AS low, {r(_high, 2)} AS high, {r(f'{_low} / travellers', 2)} AS person_low, {r(f'{_high} / travellers', 2)} AS person_high FROM v_cost0"


def cost(spark, root):
    return A.cost_range(V.trips(spark, root), V.activities(spark, root), V.places(spark, root))


@query("C14_cost_range", "SELECT trip, low, high, person_low, person_high FROM v_cost")
def c14(spark, root):
    return cost(spark, root)


VIEWS["v_budget_issues"] = "SELECT trip AS plan, CASE WHEN person_low > budget THEN 'over_budget' WHEN person_high > budget THEN 'budget_at_risk' END AS code FROM v_cost WHERE budget IS NOT NULL AND person_high > budget"


@query("C11_budget", "SELECT plan, code FROM v_budget_issues")
def c11(spark, root):
    trips = V.trips(spark, root).select("trip", "budget")
    code = F.when(F.col("person_low") > F.col("budget"), "over_budget").when(F.col("person_high") > F.col("budget"), "budget_at_risk")
    return cost(spark, root).join(trips, "trip").select(F.col("trip").alias("plan"), code.alias("code")).where("code is not null")


ALL_SQL = " UNION ALL ".join(check_sql(g) for g in CHECKS) + """ UNION ALL SELECT * FROM v_dups UNION ALL SELECT * FROM v_day_issues
  UNION ALL SELECT trip, NULL, NULL, 'empty_itinerary', 'error' FROM v_trips t WHERE NOT EXISTS (SELECT 1 FROM v_acts a WHERE a.plan = t.trip AND a.kind = 'visit')
  UNION ALL SELECT plan, NULL, place, 'mandatory_attraction_missing', 'error' FROM v_missing UNION ALL SELECT plan, NULL, NULL, code, 'warning' FROM v_budget_issues"""


def all_issues(spark, root):
    acts, trips = V.activities(spark, root), V.trips(spark, root)
    per_stop = A.stop_issues(audited_stops(spark, root))
    per_plan = A.plan_issues(trips, acts.where("kind = 'visit'"), required(spark, root), cost(spark, root))
    parts = [per_stop, duplicate_issues(acts), A.day_issues(acts, trips), per_plan]
    out = parts[0].select(*A.ISSUE_COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*A.ISSUE_COLUMNS))
    return out


@query("C12_audit_report", f"""
  WITH i AS ({ALL_SQL})
  SELECT t.trip AS plan, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS valid
  FROM v_trips t LEFT JOIN i ON i.plan = t.trip GROUP BY t.trip""")
def c12(spark, root):
    return A.report(all_issues(spark, root), V.trips(spark, root).select(F.col("trip").alias("plan")))


VIEWS["v_issue_counts"] = f"SELECT code, severity, count(*) AS n FROM ({ALL_SQL}) GROUP BY ALL"


@query("C12_issue_counts", "SELECT code, severity, n FROM v_issue_counts")
def c12b(spark, root):
    return all_issues(spark, root).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query("C13_reaudit_stored_plans", """
  WITH w AS (SELECT place, wd, opens, closes - 120 AS closes FROM v_windows WHERE NOT (opens = 0 AND closes = 1440) UNION ALL SELECT place, wd, opens, closes FROM v_windows WHERE opens = 0 AND closes = 1440)
  SELECT a.plan, a.day, a.place, CASE WHEN NOT a.opened THEN 'closed_on_this_day' ELSE 'outside_opening_hours' END AS code FROM v_aud a
  WHERE a.kind = 'visit' AND (NOT a.opened OR NOT EXISTS (SELECT 1 FROM w WHERE w.place = a.place AND w.wd = a.wd AND w.opens <= a.start_min AND a.end_min <= w.closes))""")
def c13(spark, root):
    """Stored plans against a catalogue whose places now close two hours earlier."""
    path = catalogue.sink(V.activities(spark, root), work_path(spark, "stored-plans"))
    today = V.places(spark, root).withColumn("windows", F.expr("transform(windows, w -> named_struct('dow', w.dow, 'opens', w.opens, 'closes', w.closes - 120))"))
    found = A.stop_issues(with_openings(dated_stops(spark, root, spark.read.parquet(path)), today), *codes("C6"))
    return found.select("plan", "day", "place", "code")


METRICS = f"""SELECT plan, version, {r('sum(travel_km)', 3)} AS km, CAST(sum(travel_min) AS BIGINT) AS minutes, CAST(sum(CASE WHEN kind = 'visit' THEN end_min - start_min ELSE 0 END) AS BIGINT) AS visit_minutes,
  count(DISTINCT CASE WHEN kind = 'visit' THEN place END) AS places, {r("sum(CASE WHEN kind = 'visit' THEN weather ELSE 0e0 END)", 4)} AS utility FROM v_acts GROUP BY plan, version"""
VIEWS["v_plan_metrics"] = METRICS


def plan_metrics(acts):
    visit = F.col("kind") == "visit"
    return acts.groupBy("plan", "version").agg(
        rnd(F.sum("travel_km"), 3).alias("km"), F.sum("travel_min").alias("minutes"), F.sum(F.when(visit, F.col("end_min") - F.col("start_min")).otherwise(0)).alias("visit_minutes"),
        F.count_distinct(F.when(visit, F.col("place"))).alias("places"), rnd(F.sum(F.when(visit, F.col("weather")).otherwise(0.0)), 4).alias("utility"),
    )


@query("C15_plan_metrics", "SELECT * FROM v_plan_metrics")
def c15(spark, root):
    return plan_metrics(V.activities(spark, root))


@query("G14_paired_comparison", f"""
  WITH d AS (SELECT a.plan, 100e0 * (a.km - b.km) / greatest(0.01e0, a.km) AS km_cut, 100e0 * (a.minutes - b.minutes) / greatest(1, a.minutes) AS min_cut, b.places - a.places AS places_delta, b.utility - a.utility AS utility_delta
    FROM v_plan_metrics a JOIN v_plan_metrics b ON b.plan = a.plan AND a.version = 1 AND b.version = 2)
  SELECT count(*) AS cases, {r('avg(km_cut)', 3)} AS km_cut, {r('avg(min_cut)', 3)} AS min_cut, {r('avg(places_delta)', 3)} AS places_delta, {r('avg(utility_delta)', 3)} AS utility_delta, {r('median(km_cut)', 3)} AS median_km_cut FROM d""")
def g14(spark, root):
    m = plan_metrics(V.activities(spark, root))
    side = lambda v, name: m.where(F.col("version") == v).select("plan", *[F.col(c).alias(f"{name}_{c}") for c in ("km", "minutes", "places", "utility")])
    d = side(1, "a").join(side(2, "b"), "plan").select(
        (100.0 * (F.col("a_km") - F.col("b_km")) / F.greatest(F.lit(0.01), "a_km")).alias("km_cut"),
        (100.0 * (F.col("a_minutes") - F.col("b_minutes")) / F.greatest(F.lit(1), "a_minutes")).alias("min_cut"),
        (F.col("b_places") - F.col("a_places")).alias("places_delta"), (F.col("b_utility") - F.col("a_utility")).alias("utility_delta"),
    )
    d = cut(d, "pairs")
    # the median is ranked over distinct values and their counts, in buckets that follow their order
    values = d.where("km_cut is not null").groupBy("km_cut").agg(F.count("*").alias("n")).withColumn("run", F.lit(1))
    bucket = F.floor(F.signum("km_cut") * F.log1p(F.abs("km_cut")) * 1024)
    upto = grouped.running_sums(values, ["run"], bucket, [F.col("km_cut")], {"upto": F.col("n")})
    total = values.agg(F.sum("n")).scalar()
    at = lambda pos: F.min(F.when(F.col("upto") >= F.floor(pos), F.col("km_cut")))
    middle = upto.withColumn("total", total).agg(((at((F.col("total") + 1) / 2) + at(F.col("total") / 2 + 1)) / 2.0).alias("m"))
    means = d.agg(F.count("*").alias("cases"), *[rnd(F.avg(c), 3).alias(c) for c in d.columns])
    return means.withColumn("median_km_cut", rnd(middle.select("m").scalar(), 3))
