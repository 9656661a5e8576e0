"""Group ranking: member utilities, aggregation rules, selections and their evaluation.

All trips advance together. A trip meets only the places of its own circuit, through an
equi-join on the circuit, and everything after that is partially aggregated per
(trip, place), (trip, member) or trip.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions import clock, constants as K, geo
from waymark.functions.stats import bound, clamp, consensus, jain, lookup, rnd
from waymark.operators import shaping as S


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def utility() -> Column:
    """Cosine of stated preferences and interest weights, overridden by explicit choices."""
    position = "array_position(ranked, place)"
    boosted = f"least(1D, cosine + {K.SHORTLIST_BOOST}D * (1D - ({position} - 1) / greatest(1, size(ranked))))"
    raw = (
        "case when cosine is null then 0D when array_contains(must_places, place) then 1D when array_contains(avoid_places, place) then 0D "
        f"when {position} > 0 then {boosted} else cosine end"
    )
    return rnd(clamp(F.expr(raw), 0.0, 1.0), 6)


def wishes() -> Column:
    """Number of distinct must-visit places of a member."""
    return F.size(F.array_distinct("must_places"))


def _dot(a: str, b: str) -> str:
    return " + ".join(f"{a}_{i} * {b}_{i}" for i in K.INTERESTS)


def utility_grid(trips: DataFrame, members: DataFrame, places: DataFrame) -> DataFrame:
    """(trip, member, weight, must_places, ranked, place, u) for members not opted out."""
    stated = [f"greatest(0D, least(5D, coalesce({i}, 3D))) / 5D AS m_{i}" for i in K.INTERESTS]
    going = members.where("status <> 'opted_out'").join(trips.select("trip", "circuit"), "trip").selectExpr(
        "trip", "circuit", "member", "weight", "must_places", "avoid_places", "ranked", *stated
    )
    items = places.select("place", "circuit", *S.interest_vector())
    # cosine is null where either vector is all zero
    matched = going.join(items, "circuit").withColumn(
        "cosine", F.expr(f"({_dot('m', 'a')}) / nullif(sqrt({_dot('m', 'm')}) * sqrt({_dot('a', 'a')}), 0D)")
    )
    return matched.select("trip", "member", "weight", "must_places", "ranked", "place", utility().alias("u"))


def aggregated(grid: DataFrame, deficits: DataFrame | None = None) -> DataFrame:
    """All per-item rules in one pass: simple, weighted, max-min and fairness-aware."""
    g = grid
    boost = F.lit(0.0)
    if deficits is not None:
        g = grid.join(deficits.select("trip", "member", "deficit"), ["trip", "member"], "left")
        boost = K.DEFICIT_BOOST * F.sum(F.col("u") * F.greatest(F.lit(0.0), F.coalesce("deficit", F.lit(0.0)))) / F.count("*")
    weighted = F.sum(F.col("u") * F.col("weight")) / F.sum("weight")
    least = F.min("u")
    fair = clamp(K.ALPHA * weighted + (1 - K.ALPHA) * least + boost, 0.0, 1.5)
    return g.groupBy("trip", "place").agg(
        rnd(F.avg("u"), 6).alias("simple"), rnd(weighted, 6).alias("weighted"), least.alias("least"), rnd(fair, 6).alias("fair")
    )


def borda(grid: DataFrame) -> DataFrame:
    """Rank points per place in [0, 1]; equal utilities share the average of their positions.

    Ranks come from a per-member count of distinct utility values, so the window runs over the
    few distinct values of a member, not over all of the member's rows.
    """
    position = F.array_position("ranked", F.col("place"))
    base = F.when(position > 0, 1.0 + (F.size("ranked") - (position - 1))).otherwise(F.col("u"))
    g = grid.select("trip", "member", "weight", "place", base.alias("base"))
    values = g.groupBy("trip", "member", "base").agg(F.count("*").alias("ties"))
    mine = W.partitionBy("trip", "member")
    ranks = values.select(
        "trip", "member", "base",
        (F.sum("ties").over(mine) - 1
         - F.coalesce(F.sum("ties").over(mine.orderBy(F.desc("base")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
         - (F.col("ties") - 1) / 2.0).alias("points"),
        F.sum("ties").over(mine).alias("n"),
    )
    ceiling = (F.max("n") - 1) * F.sum("weight")
    return g.join(ranks, ["trip", "member", "base"]).groupBy("trip", "place").agg(
        F.coalesce(rnd(F.try_divide(F.sum(F.col("points") * F.col("weight")), ceiling), 6), F.lit(0.0)).alias("borda")
    )


def member_coverage(grid: DataFrame, selection: DataFrame, keys: list[str]) -> DataFrame:
    """Per member the mean of the top five utilities in a selection, mixed with the honoured share of must-visits.

    A selection holds a bounded number of places per group, so its utilities fit a small array.
    """
    top = F.slice(F.sort_array(F.collect_list("u"), False), 1, 5)
    per_member = grid.join(selection, ["trip", "place"]).groupBy(*keys, "member").agg(
        top.alias("top"), F.count_if(F.array_contains("must_places", F.col("place"))).alias("honoured"),
        F.max(wishes()).alias("wishes"),
    )
    mean = F.aggregate("top", F.lit(0.0), lambda s, x: s + x) / F.size("top")
    mixed = F.when(F.col("wishes") > 0, 0.7 * mean + 0.3 * (F.col("honoured") / F.col("wishes"))).otherwise(mean)
    return per_member.select(*keys, "member", rnd(F.least(F.lit(1.0), mixed), 6).alias("value"))


def satisfaction(coverage: DataFrame, keys: list[str]) -> DataFrame:
    return coverage.groupBy(*keys).agg(
        rnd(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"),
        F.min_by("member", F.struct("value", "member")).alias("least_member"),
        jain(F.col("value")).alias("jain"), consensus(F.col("value")).alias("consensus"),
        rnd(F.max("value") - F.min("value"), 6).alias("spread"),
    )


def deficits(coverage: DataFrame) -> DataFrame:
    """How far below the trip mean each member sits."""
    mean = coverage.groupBy("trip").agg(rnd(F.avg("value"), 6).alias("mean"))
    return coverage.join(mean, "trip").select(
        "trip", "member", rnd(F.greatest(F.lit(0.0), F.col("mean") - F.col("value")), 6).alias("deficit")
    )


def _with_pick(state: Column, item: Column) -> Column:
    """``state`` after one more place: its number, each member's five best utilities and wishes met."""
    mine = lambda i: F.filter(item["votes"], lambda v: v["i"] == i)
    return F.struct(
        F.concat(state["picked"], F.array(item["place"])).alias("picked"),
        F.transform(
            state["best"], lambda b, i: F.slice(F.sort_array(F.concat(b, F.transform(mine(i), lambda v: v["u"])), False), 1, 5)
        ).alias("best"),
        F.transform(state["met"], lambda n, i: n + F.aggregate(mine(i), F.lit(0), lambda s, v: s + v["wished"])).alias("met"),
    )


def _worth(state: Column, item: Column) -> Column:
    """What a place would add: the satisfaction of its members with it, mixed with its own score."""

    def value(v):
        held = F.concat(F.get(state["best"], v["i"]), F.array(v["u"]))
        five = F.slice(F.sort_array(held, False), 1, 5)
        mean = F.aggregate(five, F.lit(0.0), lambda s, x: s + x) / F.size(five)
        honoured = (F.get(state["met"], v["i"]) + v["wished"]) / v["wishes"]
        return rnd(F.least(F.lit(1.0), F.when(v["wishes"] > 0, 0.7 * mean + 0.3 * honoured).otherwise(mean)), 6)

    def mixed(values):
        mean = rnd(F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values), 6)
        objective = K.ALPHA * mean + (1 - K.ALPHA) * F.array_min(values)
        return rnd((1 - K.ITEM_WEIGHT) * objective + K.ITEM_WEIGHT * item["score"], 9)

    return bound(F.transform(item["votes"], value), mixed)


def select_fairly(grid: DataFrame, scores: DataFrame, k: int | str) -> DataFrame:
    """(trip, place, step): mandatory places (step 0) first, then the best marginal pick until ``k`` are chosen.

    ``scores`` carries (trip, place, total, mandatory); ``k`` is a number or the name of a column of
    ``scores`` that holds one per trip. A trip meets the places of one circuit and its own travellers
    only, so all of it fits one row, and the picks are one fold over that row: no job per pick. The
    picks do not depend on ``k``, so one run serves every smaller number through ``chosen_first``.
    """
    size = F.col(k) if isinstance(k, str) else F.lit(k)
    scale = scores.groupBy("trip").agg(F.max(F.abs("total")).alias("top"), F.max(size).cast("int").alias("most"))
    wished = F.coalesce(F.array_contains("must_places", F.col("place")).cast("int"), F.lit(0))
    vote = F.struct("member", "u", wished.alias("wished"), wishes().alias("wishes"))
    voted = grid.groupBy("trip", "place").agg(F.array_sort(F.collect_list(vote)).alias("votes"))
    items = scores.select("trip", "place", "mandatory", "total").join(scale, "trip").join(voted, ["trip", "place"], "left").groupBy("trip").agg(
        F.array_sort(F.collect_list(F.struct(
            "place", "mandatory", F.coalesce(F.try_divide(F.col("total"), F.col("top")), F.lit(0.0)).alias("score"),
            F.coalesce("votes", F.array().cast("array<struct<member:bigint,u:double,wished:int,wishes:int>>")).alias("votes"),
        ))).alias("items"),
        F.max("most").alias("most"),
    )
    people = F.array_sort(F.array_distinct(F.flatten(F.transform("items", lambda t: F.transform(t["votes"], lambda v: v["member"])))))
    seat = lambda v: (F.array_position("people", v["member"]) - 1).cast("int").alias("i")
    seated = F.transform("items", lambda t: F.struct(
        t["place"].alias("place"), t["mandatory"].alias("mandatory"), t["score"].alias("score"),
        F.transform(t["votes"], lambda v: F.struct(seat(v), v["u"].alias("u"), v["wished"].alias("wished"), v["wishes"].alias("wishes"))).alias("votes"),
    ))
    nobody = F.struct(
        F.array().cast("array<bigint>").alias("picked"),
        F.transform("people", lambda m: F.array().cast("array<double>")).alias("best"),
        F.transform("people", lambda m: F.lit(0)).alias("met"),
    )

    def pick(state):
        rest = F.filter("items", lambda t: (F.size(t["votes"]) > 0) & ~F.array_contains(state["picked"], t["place"]))
        ranked = F.transform(rest, lambda t: F.struct(_worth(state, t).alias("worth"), (-t["place"]).alias("p"), t.alias("item")))
        return bound(F.array_max(F.transform(ranked, lambda w: F.struct(w["worth"].alias("worth"), w["p"].alias("p")))), lambda top: F.when(
            top.isNull(), state
        ).otherwise(_with_pick(state, F.get(F.filter("items", lambda t: t["place"] == -top["p"]), F.lit(0)))))

    start = F.aggregate(F.filter("items", lambda t: t["mandatory"]), nobody, _with_pick)
    chosen = F.aggregate(
        "items", F.col("start"), lambda state, _: F.when(F.size(state["picked"]) < F.col("most"), pick(state)).otherwise(state),
        lambda state: state["picked"],
    )
    folded = items.withColumn("people", people).withColumn("items", seated).withColumn("start", start).select(
        "trip", F.size("start.picked").alias("given"), F.posexplode(chosen).alias("pos", "place")
    )
    return folded.select("trip", "place", F.greatest(F.lit(0), F.col("pos") + 1 - F.col("given")).alias("step"))


def chosen_first(picks: DataFrame, k: Column) -> DataFrame:
    """The selection of at most ``k`` places within ``picks`` of select_fairly; mandatory places always stay."""
    given = picks.where("step = 0").groupBy("trip").agg(F.countDistinct("place").alias("given"))
    return picks.join(given, "trip", "left").fillna(0, ["given"]).where((F.col("step") == 0) | (F.col("given") + F.col("step") <= k)).drop("given")


# ------------------------------------------------------------------ eligibility and scores
def trip_needs(trips: DataFrame, members: DataFrame) -> DataFrame:
    """Trips with their weekdays, months and their members' needs, wishes and vetoes."""
    needs = members.where("status <> 'opted_out'").groupBy("trip").agg(
        F.bool_or("is_senior").alias("any_senior"), F.bool_or("is_child").alias("any_child"),
        F.bool_or(F.col("mobility") == "wheelchair").alias("any_wheelchair"),
        F.bool_or(F.col("mobility") == "limited_walking").alias("any_limited"),
        F.flatten(F.collect_list("must_places")).alias("member_musts"), F.flatten(F.collect_list("avoid_places")).alias("vetoes"),
    )
    weekdays = F.transform(F.sequence("start_date", "end_date"), lambda d: F.weekday(d))
    months = F.array_distinct(F.transform(F.sequence("start_date", "end_date"), lambda d: F.month(d)))
    return trips.join(needs, "trip").withColumns(
        {"weekdays": weekdays, "trip_months": months, "musts": F.array_union("must_own", "member_musts")}
    )


def trip_frame(trips: DataFrame, members: DataFrame, weather: DataFrame) -> DataFrame:
    """Trips with what they need and the weather of each day as a small array."""
    forecast = weather.groupBy("trip").agg(
        F.array_sort(F.collect_list(F.struct("day_index", "t_max", "t_min", "mm", "prob", "wind", "visibility"))).alias("forecast")
    )
    return trip_needs(trips, members).join(forecast, "trip", "left")


def reject_reasons() -> Column:
    """Array of the hard rules a place breaks for a trip, in order."""
    opened = F.filter("weekdays", lambda wd: F.size(clock.open_windows(F.col("windows"), F.col("closed_dow"), wd)) > 0)
    fits = F.exists(
        "weekdays",
        lambda wd: F.exists(
            clock.open_windows(F.col("windows"), F.col("closed_dow"), wd),
            lambda w: F.least(w["closes"], F.col("day_end")) - F.greatest(w["opens"], F.col("day_start")) >= F.col("min_dur"),
        ),
    )
    daily = F.col("budget") / F.col("days") * 0.45
    rules = [
        (F.array_contains("avoid_own", F.col("place")), "excluded_by_group"),
        (F.size(opened) == 0, "closed_for_entire_trip"),
        ((F.size(opened) > 0) & ~fits, "cannot_fit_in_daily_window"),
        (F.col("needs_access") & (F.col("access") == "no"), "not_wheelchair_accessible"),
        (F.col("any_wheelchair") & (F.col("access") == "no"), "member_requires_step_free_access"),
        (F.col("any_limited") & (F.col("intensity") >= 5), "too_physically_demanding_for_a_member"),
        (F.col("budget").isNotNull() & (F.col("fee_min") > F.greatest(daily, F.lit(150.0))), "entry_fee_exceeds_budget"),
        (F.array_contains("vetoes", F.col("place")), "vetoed_by_member"),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))


def eligibility(trips: DataFrame, members: DataFrame, places: DataFrame) -> DataFrame:
    """(trip, place, reasons) for every place of a trip's circuit, without any score."""
    return trip_needs(trips, members).join(places, "circuit").select("trip", "place", reject_reasons().alias("reasons"))


def day_weather_score(w: Column) -> Column:
    exposure, sens = lookup(K.EXPOSURE, F.col("kind"), 1.0), F.col("sens")
    mm, p = F.coalesce(w["mm"], F.lit(0.0)), F.coalesce(w["prob"], F.lit(0.0))
    severity = F.least(F.lit(1.0), F.greatest(mm / 25.0, p))
    wet = F.when((mm >= 5.0) | (p >= 0.6), 0.75 * severity * exposure * F.greatest(F.lit(0.4), sens)).otherwise(0.0)
    hot = F.when(w["t_max"] >= 35.0, 0.45 * F.least(F.lit(1.0), (w["t_max"] - 33) / 12.0) * exposure).otherwise(0.0)
    cold = F.when(w["t_min"] <= 2.0, 0.35 * F.least(F.lit(1.0), (3 - w["t_min"]) / 10.0) * exposure).otherwise(0.0)
    views = F.arrays_overlap("tags", F.array(F.lit("viewpoint"), F.lit("photo-spot")))
    murk = F.when((w["visibility"] < 3.0) & views, 0.6).otherwise(0.0)
    wind = F.when((w["wind"] > 45) & (exposure > 0.5), 0.25).otherwise(0.0)
    return clamp(F.lit(1.0) - wet - hot - cold - murk - wind, 0.0, 1.0)


def components() -> dict[str, Column]:
    """Component scores of a place for a trip, from a row of trip, place and utility columns."""
    shared = F.size(F.array_intersect("trip_months", "months")) / F.size("trip_months")
    season = F.when(F.size("months") == 0, F.lit(1.0)).otherwise(rnd(shared + (1 - shared) * (1.0 - F.col("sens")), 4))
    weather = F.aggregate("forecast", F.lit(0.0), lambda s, w: s + day_weather_score(w)) / F.size("forecast")
    daily = F.greatest(F.lit(150.0), F.col("budget") / F.col("days") * 0.45)
    cost = (F.col("fee_min") + F.col("fee_max")) / 2.0
    budget = F.when(F.col("budget").isNull() | (cost <= 0), F.lit(1.0)).otherwise(
        rnd(F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), cost / daily)), 4)
    )
    calm = 1.0 - (F.col("intensity") - 1) / 4.0
    access = lookup(K.ACCESS_SCORING, F.col("access"), 0.35)
    access = F.when(F.col("seniors") | F.col("any_senior"), 0.5 * access + 0.5 * (F.col("senior") / 5.0)).otherwise(access)
    access = F.when(F.col("children") | F.col("any_child"), 0.6 * access + 0.4 * (F.col("child") / 5.0)).otherwise(access)
    access = F.when(F.col("needs_access") | F.col("seniors") | F.col("children"), access).otherwise(0.35 + 0.65 * calm)
    access = F.when(F.col("any_limited"), 0.5 * access + 0.5 * calm).otherwise(access)
    distance = F.when(F.col("max_km") <= 0, F.lit(0.0)).otherwise(rnd(F.least(F.lit(1.0), F.col("km") / F.col("max_km")), 4))
    return {
        "interest_match": rnd(F.least(F.lit(1.0), F.col("fair")), 4),
        "group_fairness": rnd(F.col("least"), 4),
        "attraction_quality": rnd(F.col("quality"), 4),
        "weather_suitability": F.coalesce(rnd(weather, 4), F.lit(1.0)),
        "seasonal_suitability": season,
        "accessibility_suitability": rnd(clamp(access, 0.0, 1.0), 4),
        "budget_suitability": budget,
        "evidence_quality": F.col("evidence"),
        "distance_penalty": distance,
        "crowd_penalty": lookup(K.CROWD_PENALTY_SCORING, F.col("crowd"), 0.3),
    }


def total_score() -> Column:
    plus = _sum([w * F.col(c) for c, w in K.SCORE_WEIGHTS.items()])
    minus = _sum([w * F.col(c) for c, w in K.SCORE_PENALTIES.items()])
    return rnd(plus - minus + F.when(F.col("mandatory"), 1.0).otherwise(0.0), 6)


def scored(trips: DataFrame, members: DataFrame, places: DataFrame, sources: DataFrame, weather: DataFrame) -> DataFrame:
    """Every (trip, place of its circuit) with reasons, components, total and mandatory flag."""
    frame = trip_frame(trips, members, weather)
    rules = aggregated(utility_grid(trips, members, places))
    items = S.evidence(places, sources).drop("best_source", "n_sources")
    km = geo.haversine_km(F.col("base_lat"), F.col("base_lon"), F.col("lat"), F.col("lon"))
    pairs = frame.join(items, "circuit").withColumn("km", km).join(rules, ["trip", "place"])
    furthest = frame.select("trip", "circuit", "base_lat", "base_lon").join(
        places.select("circuit", "lat", "lon"), "circuit"
    ).groupBy("trip").agg(F.max(km).alias("max_km"))
    out = pairs.join(furthest, "trip").withColumns(
        {"reasons": reject_reasons(), "mandatory": F.array_contains("musts", F.col("place")), **components()}
    )
    return out.withColumn("total", total_score())
