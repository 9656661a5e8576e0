"""Numeric helpers: guarded rounding, rates, level lookups, fairness indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUND_GUARD = 1e-9


def rnd(col: Column, places: int) -> Column:
    """Round, with a guard so that decimal ties do not depend on binary noise."""
    return F.round(col + F.lit(ROUND_GUARD), places)


def rate(numerator: Column, denominator: Column, places: int = 4) -> Column:
    """Share rounded to ``places``; 0.0 where the denominator is zero."""
    share = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce(rnd(share, places), F.lit(0.0))


def sql_value(value) -> str:
    """A constant as Spark SQL text."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def sql_map(mapping: dict) -> str:
    return "map(" + ", ".join(f"{sql_value(k)}, {sql_value(v)}" for k, v in mapping.items()) + ")"


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Value of ``key`` in a small fixed mapping (one map constant, parsed once)."""
    found = F.try_element_at(F.expr(sql_map(mapping)), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def jain(value: Column) -> Column:
    """Aggregate: (sum x)^2 / (n sum x^2) over non-negative parts."""
    x = F.greatest(F.lit(0.0), value)
    total, squares, n = F.sum(x), F.sum(x * x), F.count(value)
    return (
        F.when(n == 0, F.lit(0.0))
        .when(total == 0, F.lit(1.0))
        .otherwise(rnd(F.try_divide(total * total, n * squares), 6))
    )


def consensus(value: Column) -> Column:
    """Aggregate: 1 - population deviation / 0.5, floored at 0; 1.0 below two values."""
    spread = F.stddev_pop(value)
    return F.when(F.count(value) < 2, F.lit(1.0)).otherwise(
        rnd(F.greatest(F.lit(0.0), F.lit(1.0) - spread / F.lit(0.5)), 6)
    )
