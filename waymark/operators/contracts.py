"""Executable data contracts: rules as columns, all failures counted in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractViolation(ValueError):
    """Raised with every failed rule of a dataset, not only the first."""


@dataclass(frozen=True)
class Rule:
    name: str
    holds: Column
    severity: str = "error"


def required(name: str) -> Rule:
    return Rule(f"{name}_not_null", F.col(name).isNotNull())


def matches(name: str, pattern: str) -> Rule:
    return Rule(f"{name}_pattern", F.col(name).isNull() | F.col(name).rlike(pattern))


def within(name: str, low, high) -> Rule:
    return Rule(f"{name}_range", F.col(name).isNull() | F.col(name).between(low, high))


def one_of(name: str, values) -> Rule:
    return Rule(f"{name}_allowed", F.col(name).isNull() | F.col(name).isin(list(values)))


def length(name: str, low: int, high: int | None = None) -> Rule:
    """At least ``low`` characters, and at most ``high`` where it is given."""
    n = F.length(name)
    return Rule(f"{name}_length", F.col(name).isNull() | ((n >= low) if high is None else n.between(low, high)))


def starts(name: str, prefix: str) -> Rule:
    return Rule(f"{name}_prefix", F.col(name).isNull() | F.startswith(F.col(name), F.lit(prefix)))


def typed(name: str, kind: str) -> Rule:
    return Rule(f"{name}_type", F.col(name).isNull() | F.col(name).cast("string").try_cast(kind).isNotNull())


def _broken(rule: Rule) -> Column:
    return ~F.coalesce(rule.holds, F.lit(False))


def check(df: DataFrame, rules: list[Rule], dataset: str) -> DataFrame:
    """(dataset, rule, severity, rows, failures): one aggregate over the data."""
    counted = df.agg(F.count("*").alias("rows"), *[F.count_if(_broken(r)).alias(r.name) for r in rules])
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(r.name).alias("failures")) for r in rules])
    return counted.select(F.lit(dataset).alias("dataset"), "rows", F.inline(each))


def failing_rows(df: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """(key, rule) of every broken rule."""
    names = F.array_compact(F.array(*[F.when(_broken(r), F.lit(r.name)) for r in rules]))
    return df.select(key, F.explode(names).alias("rule"))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def validate(df: DataFrame, rules: list[Rule], dataset: str, unique: list[list[str]] = ()) -> DataFrame:
    """Return ``df`` if every rule holds, else raise with all failures."""
    failed = {r["rule"]: r["failures"] for r in check(df, rules, dataset).where("failures > 0").collect()}
    for keys in unique:
        extra = repeated(df, keys).count()
        if extra:
            failed["unique(" + ",".join(keys) + ")"] = extra
    if failed:
        raise ContractViolation(f"{dataset}: " + ", ".join(f"{name}={n}" for name, n in sorted(failed.items())))
    return df


def gate(checks: DataFrame) -> None:
    """Raise with the names of failed error-severity checks; the check table is a few rows."""
    failed = [r["name"] for r in checks.where("severity = 'error' and not passed").orderBy("name").collect()]
    if failed:
        raise ContractViolation("quality gate failed: " + ", ".join(failed))
