"""Plan auditing and cost ranges for all stored plans at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import clock, constants as K
from waymark.functions.stats import lookup, rnd

TRAVEL_SLACK = 2  # minutes that a leg may run over its gap
MEAL_AFTER = 360  # day windows longer than this need a meal
ISSUE_COLUMNS = ["plan", "day", "place", "code", "severity"]


def _issue(condition: Column, code: str, severity: str) -> Column:
    return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))


def stop_checks() -> dict[str, tuple[str, Column]]:
    """Severity and condition of every issue that a single stop and its predecessor can show."""
    visit = (F.col("kind") == "visit") & F.col("typ").isNotNull()
    opened = F.size("open") > 0
    inside = F.exists("open", lambda w: (w["opens"] <= F.col("start_min")) & (F.col("end_min") <= w["closes"]))
    length = F.col("end_min") - F.col("start_min")
    gap = F.col("start_min") - F.col("prev_end")
    return {
        "overlapping_activities": ("error", gap < 0),
        "starts_before_day_window": ("error", F.col("start_min") < F.col("day_start")),
        "ends_after_day_window": ("error", F.col("end_min") > F.col("day_end")),
        "non_positive_duration": ("error", length <= 0),
        "insufficient_travel_time": ("error", F.col("travel_min") - gap > TRAVEL_SLACK),
        "closed_on_this_day": ("error", visit & ~opened),
        "outside_opening_hours": ("error", visit & opened & ~inside),
        "visit_too_short": ("error", visit & (length < F.col("min_dur"))),
        "visit_longer_than_needed": ("warning", visit & (length > F.col("max_dur"))),
        "accessibility_violation": ("error", visit & F.col("needs_access") & (F.col("access") == "no")),
        "poor_weather_for_outdoor_activity": ("warning", visit & (F.col("weather") < 0.45) & (F.col("exposure") == "outdoor")),
    }


def stop_issues(stops: DataFrame, *codes: str) -> DataFrame:
    """Issues of the named codes (all, if none is named), in one pass over the activities.

    ``stops``: activities with what the named checks look at: ``prev_end``, ``day_start`` and
    ``day_end`` of the trip, trip and place attributes, the ``open`` intervals of the weekday (null
    for unknown places). Columns that no named check uses need not be there.
    """
    checks = stop_checks()
    found = F.array_compact(F.array(*[_issue(checks[c][1], c, checks[c][0]) for c in codes or checks]))
    return stops.select("plan", "day", "place", F.inline(found))


def open_by_weekday(places: DataFrame) -> DataFrame:
    """(place, wd, open): seven rows per place, so activities join their intervals ready-made."""
    week = places.select("place", "windows", "closed_dow", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("wd"))
    return week.select("place", "wd", clock.open_windows(F.col("windows"), F.col("closed_dow"), F.col("wd")).alias("open"))


def day_issues(acts: DataFrame, trips: DataFrame) -> DataFrame:
    """Daily travel, number of stops and missing meal, against the pace of the trip."""
    days = acts.groupBy("plan", "day").agg(
        F.sum("travel_min").alias("travel"), F.count_if(F.col("kind") == "visit").alias("visits"), F.count_if(F.col("kind") == "meal").alias("meals")
    ).join(trips.select(F.col("trip").alias("plan"), "pace", (F.col("day_end") - F.col("day_start")).alias("window")), "plan")
    found = F.array_compact(F.array(
        _issue(F.col("travel") > lookup(K.PACE_MAX_TRAVEL_MIN, F.col("pace"), 210), "excessive_daily_travel", "warning"),
        _issue(F.col("visits") > lookup(K.PACE_MAX_ACTIVITIES, F.col("pace"), 4), "too_many_activities", "warning"),
        _issue((F.col("window") > MEAL_AFTER) & (F.col("visits") > 0) & (F.col("meals") == 0), "no_meal_break", "warning"),
    ))
    return days.select("plan", "day", F.lit(None).cast("bigint").alias("place"), F.inline(found))


def plan_issues(trips: DataFrame, visits: DataFrame, required: DataFrame, cost: DataFrame) -> DataFrame:
    """Empty plans, missing must-visits and budget warnings."""
    nothing = F.lit(None)
    row = lambda df, place, code, severity: df.select(
        F.col("trip").alias("plan"), nothing.cast("int").alias("day"), place.cast("bigint").alias("place"), F.lit(code).alias("code"), F.lit(severity).alias("severity")
    )
    seen = visits.select(F.col("plan").alias("trip"), "place").distinct()
    empty = row(trips.join(seen, "trip", "left_anti"), nothing, "empty_itinerary", "error")
    missing = row(required.join(seen, ["trip", "place"], "left_anti"), F.col("place"), "mandatory_attraction_missing", "error")
    code = F.when(F.col("person_low") > F.col("budget"), "over_budget").when(F.col("person_high") > F.col("budget"), "budget_at_risk")
    budget = cost.join(trips.select("trip", "budget"), "trip").withColumn("code", code).where("code is not null").select(
        F.col("trip").alias("plan"), nothing.cast("int").alias("day"), nothing.cast("bigint").alias("place"), "code", F.lit("warning").alias("severity")
    )
    return empty.unionByName(missing).unionByName(budget)


def report(issues: DataFrame, plans: DataFrame) -> DataFrame:
    """Errors, warnings and validity per plan; plans without issues are valid."""
    counts = issues.groupBy("plan").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")
    )
    full = plans.join(counts, "plan", "left").select("plan", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("errors", "warnings")])
    return full.withColumn("valid", F.col("errors") == 0)


def cost_range(trips: DataFrame, acts: DataFrame, places: DataFrame) -> DataFrame:
    """Low and high cost per trip: rooms, food, transport, entry fees, contingency."""
    fees = places.select("place", "fee_min", "fee_max", F.col("kind").alias("exposure")).hint("merge")  # rows outgrow the file that a broadcast is judged by
    visits = acts.where("kind = 'visit'").join(fees, "place").groupBy(F.col("plan").alias("trip")).agg(
        F.sum(F.when(F.col("fee_max") > 0, F.col("fee_min"))).alias("fee_low"), F.sum(F.when(F.col("fee_max") > 0, F.col("fee_max"))).alias("fee_high"),
        F.avg((F.col("exposure") == "outdoor").cast("double")).alias("exposed"),
    )
    travel = acts.groupBy(F.col("plan").alias("trip")).agg(F.sum("travel_km").alias("km"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    t = trips.join(travel, "trip", "left").join(visits, "trip", "left")
    rate = lambda what: lookup({k: v[what] for k, v in K.BASELINE_RATES.items()}, F.col("tier"), K.BASELINE_RATES["midrange"][what])
    people, days = F.col("travellers"), F.col("days")
    rooms, nights, vehicles = F.floor((people + 1) / 2), days - 1, F.greatest(F.lit(1), F.floor((people + 3) / 4))
    per_km = lambda i, default: lookup({k: v[i] for k, v in K.PER_KM_RATES.items()}, F.col("mode"), default)
    floor = rate("local_transport") * K.SPREAD_LOW * people * days * 0.5
    t = t.withColumns({
        "stay": rate("stay") * rooms * nights, "food": rate("food") * people * days,
        "ride_low": F.greatest(zero("km") * per_km(0, 12.0) * vehicles, floor),
        "ride_high": F.greatest(zero("km") * per_km(1, 18.0) * vehicles, floor * 1.6),
        "reserve": 0.08 + 0.01 * F.least(F.lit(7), days) + 0.07 * zero("exposed"),
    })
    low = (F.col("stay") + F.col("food")) * K.SPREAD_LOW + F.col("ride_low") + zero("fee_low") * people
    high = (F.col("stay") + F.col("food")) * K.SPREAD_HIGH + F.col("ride_high") + zero("fee_high") * people
    total_low, total_high = low * (1 + F.col("reserve") * 0.6), high * (1 + F.col("reserve"))
    return t.select(
        "trip", rnd(total_low, 2).alias("low"), rnd(total_high, 2).alias("high"), rnd(total_low / people, 2).alias("person_low"), rnd(total_high / people, 2).alias("person_high")
    )
