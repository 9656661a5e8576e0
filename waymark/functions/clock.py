"""Minutes of day, opening windows and date parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions import constants as K
from waymark.functions.stats import lookup

WINDOW_TYPE = "array<struct<dow:int,opens:int,closes:int>>"


def parse_hhmm(text: Column) -> Column:
    """"09:30" -> 570; a bare number passes as hours; empty and null -> null."""
    hours = F.split_part(text, F.lit(":"), F.lit(1)).try_cast("int")
    minutes = F.split_part(text, F.lit(":"), F.lit(2))
    value = hours * 60 + F.coalesce(F.nullif(minutes, F.lit("")).try_cast("int"), F.lit(0))
    return F.when(text.isNull() | (text == ""), F.lit(None)).otherwise(value).cast("int")


def hhmm(minutes: Column) -> Column:
    """Minutes -> HH:MM, wrapped at 48 hours."""
    m = F.pmod(minutes.cast("int"), F.lit(2880))
    return F.concat(
        F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0")
    )


def duration_text(minutes: Column) -> Column:
    hours, mins = F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")
    return (
        F.when((hours > 0) & (mins > 0), F.concat(hours.cast("string"), F.lit("h "), mins.cast("string"), F.lit("m")))
        .when(hours > 1, F.concat(hours.cast("string"), F.lit(" hours")))
        .when(hours == 1, F.lit("1 hour"))
        .otherwise(F.concat(mins.cast("string"), F.lit(" minutes")))
    )


def past_midnight(opens: Column, closes: Column) -> Column:
    return F.when(closes <= opens, closes + 1440).otherwise(closes)


def day_number(name: Column) -> Column:
    """Day name -> -1..6 (all=-1, mon=0); digits pass through."""
    return F.coalesce(lookup(K.DAY_NAMES, F.lower(name)), name.try_cast("int"))


def open_windows(windows: Column, closed_dow: Column, weekday: Column) -> Column:
    """Opening intervals on a weekday; empty = closed; all day when no hours are recorded."""
    all_day = F.array(F.struct(F.lit(0).alias("opens"), F.lit(1440).alias("closes")))
    hits = F.array_sort(
        F.transform(
            F.filter(windows, lambda w: w["dow"].isin(-1) | (w["dow"] == weekday)),
            lambda w: F.struct(w["opens"].alias("opens"), w["closes"].alias("closes")),
        )
    )
    return (
        F.when(F.array_contains(closed_dow, weekday), F.slice(all_day, 1, 0))
        .when(F.size(windows) == 0, all_day)
        .otherwise(hits)
    )


def widest_start(windows: Column, day_start: Column, day_end: Column, visit: Column) -> Column:
    """Widest feasible (earliest, latest) start; the first on ties; null if none."""
    ranges = F.filter(
        F.transform(
            windows,
            lambda w: F.struct(
                F.greatest(w["opens"], day_start).alias("earliest"),
                (F.least(w["closes"], day_end) - visit).alias("latest"),
            ),
        ),
        lambda r: r["latest"] >= r["earliest"],
    )
    ranked = F.array_sort(
        F.transform(
            ranges,
            lambda r, i: F.struct(
                (r["earliest"] - r["latest"]).alias("neg_span"), i.alias("pos"), r.alias("range")
            ),
        )
    )
    return F.try_element_at(ranked, F.lit(1))["range"]


def containing_window(windows: Column, recorded: Column, start: Column) -> Column:
    """Window holding ``start`` (open <= start < close), else the widest; null if none recorded."""
    inside = F.try_element_at(
        F.filter(windows, lambda w: (w["opens"] <= start) & (start < w["closes"])), F.lit(1)
    )
    widest = F.try_element_at(
        F.array_sort(
            F.transform(
                windows,
                lambda w, i: F.struct(
                    (w["opens"] - w["closes"]).alias("neg_span"), i.alias("pos"), w.alias("window")
                ),
            )
        ),
        F.lit(1),
    )["window"]
    return F.when(recorded, F.coalesce(inside, widest))


def visit_minutes(pace: Column, typ: Column, low: Column, high: Column) -> Column:
    return (
        F.when(pace == "packed", F.greatest(low, F.floor(typ * 0.8).cast("int")))
        .when(pace == "relaxed", F.least(high, F.floor(typ * 1.15).cast("int")))
        .otherwise(typ)
    )


def months_text(months: Column) -> Column:
    names = F.array(*[F.lit(m) for m in K.MONTH_NAMES])
    listed = F.array_join(
        F.transform(
            F.array_sort(F.filter(months, lambda m: m.between(1, 12))), lambda m: F.element_at(names, m)
        ),
        ", ",
    )
    return F.when((F.size(months) == 0) | (F.size(months) == 12), F.lit("all year")).otherwise(listed)
