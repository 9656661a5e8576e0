"""Readers and small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import session
from waymark.operators.grouped import ranked
from waymark.session import cut
from waymark.sources.tables import table

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

__all__ = ["GAP", "WORD", "cut", "documents", "free_name", "numbered", "table", "text_or_empty", "tune", "word_count"]


def tune(spark: SparkSession) -> SparkSession:
    """The library's settings, and batches of few rows: texts may be long."""
    session.tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def documents(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents")


def text_or_empty(column: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until the frame has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(stored: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """A stored table with each row's number, from 0 on, over ``keys`` (not null) in ``order``.

    Rows are range-partitioned by key and order, equal ones by where they were stored, so neither a
    hot key nor many equal rows meet in one task; a partition's rows are numbered on their own and
    moved on by the counts of the partitions before it.
    """
    nth, part = free_name(stored, "_stored_at"), free_name(stored, "_part")
    dealt = stored.withColumn(nth, F.monotonically_increasing_id()).repartitionByRange(*[F.col(k) for k in keys], *order, F.col(nth))
    parts = cut(dealt.withColumn(part, F.spark_partition_id()), "order")
    return ranked(parts, keys, F.col(part), [*order, F.col(nth)], name).withColumn(name, (F.col(name) - 1).cast("long")).drop(nth, part)
