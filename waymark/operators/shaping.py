"""Row-wise shaping and the small aggregates that feed the feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import constants as K
from waymark.functions.stats import clamp, lookup, rnd, sql_map, sql_value

MONTHS = range(1, 13)


def season_scores(months: Column, sensitivity: Column) -> list[Column]:
    """Twelve columns: 1.0 where the month is listed or none is, else reduced by sensitivity."""
    off = rnd(F.greatest(F.lit(0.0), 1.0 - 0.9 * sensitivity), 4)
    return [
        F.when((F.size(months) == 0) | F.array_contains(months, m), F.lit(1.0)).otherwise(off).alias(f"season_{m}")
        for m in MONTHS
    ]


def accessibility_feature(access: Column, intensity: Column) -> Column:
    return rnd(0.6 * lookup(K.ACCESS_FEATURE, access, 0.3) + 0.4 * (1.0 - (intensity - 1) / 4.0), 4)


def completeness(history: Column, significance: Column, facts: Column, etiquette: Column) -> Column:
    return (
        0.4 * history.cast("double")
        + 0.3 * significance.cast("double")
        + 0.2 * F.least(F.lit(1.0), facts / 3.0)
        + 0.1 * etiquette.cast("double")
    )


def source_strength(sources: DataFrame) -> DataFrame:
    """Best source score and source count per place; unknown types score 0.4."""
    score = lookup(K.SOURCE_FEATURE, F.col("source_type"), 0.4)
    return sources.groupBy("place").agg(F.max(score).alias("best_source"), F.count("*").alias("n_sources"))


def evidence(places: DataFrame, sources: DataFrame) -> DataFrame:
    """Provenance score per place: best source, source count, confidence, completeness."""
    full = completeness(
        F.col("has_history"), F.col("has_significance"), F.col("n_facts"), F.col("has_etiquette")
    )
    score = (
        0.45 * F.coalesce("best_source", F.lit(0.4))
        + 0.20 * F.least(F.lit(1.0), F.coalesce("n_sources", F.lit(0)) / 2.0)
        + 0.20 * lookup(K.CONFIDENCE, F.col("confidence"), 0.65)
        + 0.15 * full
    )
    return places.join(source_strength(sources), "place", "left").withColumn("evidence", rnd(score, 4))


def max_fee(costs: DataFrame) -> DataFrame:
    return costs.groupBy("place").agg(F.max("amount_max").alias("cost"))


def cost_index(places: DataFrame, costs: DataFrame) -> DataFrame:
    """Cost relative to the dearest place (at least 1)."""
    top = costs.agg(F.greatest(F.coalesce(F.max("amount_max"), F.lit(1.0)), F.lit(1.0))).scalar()
    per_place = places.join(max_fee(costs), "place", "left").withColumns({"cost": F.coalesce("cost", F.lit(0.0)), "top_cost": top})
    return per_place.withColumn("cost_index", rnd(F.least(F.lit(1.0), F.col("cost") / F.col("top_cost")), 4))


def interest_long(places: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, interest, weight): strongest weight per interest over the tags of a place."""
    weights = {t: w for t, w in K.TAG_INTERESTS.items() if w}
    row = lambda i, x: f"named_struct('interest', {sql_value(i)}, 'weight', {sql_value(x)})"
    dictionary = "map(" + ", ".join(
        f"{sql_value(t)}, array({', '.join(row(i, x) for i, x in w.items())})" for t, w in weights.items()
    ) + ")"
    return (
        places.select(*keys, F.explode("tags").alias("tag"))
        .select(*keys, F.inline(F.try_element_at(F.expr(dictionary), F.col("tag"))))
        .groupBy(*keys, "interest")
        .agg(F.max("weight").alias("weight"))
    )


def interest_vector(tags: str = "tags") -> list[Column]:
    """The same weights as ten columns ``a_<interest>``, computed in place without a join."""
    columns = []
    for interest in K.INTERESTS:
        weights = sql_map({t: w[interest] for t, w in K.TAG_INTERESTS.items() if interest in w})
        best = f"array_max(transform({tags}, t -> coalesce(try_element_at({weights}, t), 0D)))"
        columns.append(F.expr(f"coalesce({best}, 0D)").alias(f"a_{interest}"))
    return columns


def preference(raw: Column) -> Column:
    return clamp(F.coalesce(raw.try_cast("double"), F.lit(3.0)), 0.0, 5.0)


def split_rejects(rows: DataFrame, key: str, position: str, allowed: Column, drop_duplicates: bool = True):
    """Tag each row with a reject reason: repeated key, host not allowed, or none.

    ``position`` is unique, so the first row of a key is found by a partially aggregated minimum
    and joined back on ``position``; no key, however frequent, is gathered in one task.
    """
    first = rows.groupBy(key).agg(F.min(position).alias(position)).select(position, F.lit(True).alias("is_first"))
    tagged = rows.join(first, position, "left")
    return tagged.withColumn(
        "reason",
        F.when(F.col("is_first").isNull() & F.lit(drop_duplicates), F.lit("duplicate_key"))
        .when(~allowed, F.lit("source_not_allowed")),
    ).drop("is_first")


def weather_flags() -> dict[str, Column]:
    mm, p = F.coalesce("mm", F.lit(0.0)), F.coalesce("prob", F.lit(0.0))
    return {
        "wet": (mm >= 5.0) | (p >= 0.6),
        "hot": F.coalesce("t_max", F.lit(0.0)) >= 35.0,
        "cold": F.coalesce("t_min", F.lit(99.0)) <= 2.0,
        "low_visibility": F.coalesce(F.col("visibility") < 3.0, F.lit(False)),
    }


def condition(mm: Column, prob: Column, t_max: Column, t_min: Column) -> Column:
    return (
        F.when((t_min <= 0) & (mm >= 2), "snow")
        .when(mm >= 20, "heavy_rain")
        .when(mm >= 5, "rain")
        .when(prob >= 0.35, "showers")
        .when(t_max >= 38, "hot_clear")
        .when(prob >= 0.15, "partly_cloudy")
        .otherwise("clear")
    )
