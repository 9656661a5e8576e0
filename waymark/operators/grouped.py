"""Per-key ordering and nesting that stay balanced when one key holds much of the data.

A plain window puts a whole key into one task. These helpers split each key by a bucket that
follows the leading order column, work inside (key, bucket), and carry the little that crosses
bucket borders (counts, sums, last rows) through a small per-bucket table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _with_bucket(df: DataFrame, bucket: Column) -> DataFrame:
    return df.withColumn("_bucket", bucket)


def _rejoin(df: DataFrame, per_bucket: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(per_bucket, [*keys, "_bucket"])


def ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """``row_number`` over ``keys`` in ``order``; ``bucket`` must not decrease along the order."""
    b = _with_bucket(df, bucket)
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = b.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order))
    return _rejoin(b, offsets, keys).withColumn(name, inside + F.col("_offset")).drop("_bucket", "_offset")


def running_sums(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Cumulative sums over ``keys`` in ``order``, current row included."""
    b = _with_bucket(df, bucket).withColumns({f"_v_{n}": c for n, c in sums.items()})
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = b.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]).select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = _rejoin(b, totals, keys).withColumns(
        {n: F.sum(f"_v_{n}").over(inside) + F.col(f"_o_{n}") for n in sums}
    )
    return out.drop("_bucket", *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def previous(
    df: DataFrame, keys: list[str], bucket: Column, order: list[str], take: dict[str, str], last: dict[str, Column] | None = None
) -> DataFrame:
    """Values of the preceding row over ``keys`` ordered by the ``order`` columns (``lag``).

    Inside a bucket this is ``lag``; the first row of a bucket takes the last row of the
    nearest earlier bucket of its key. ``last`` may give the aggregate that finds a taken value
    in the last row of a bucket; on plain numbers it stays a hash aggregate, the default sorts.
    """
    b = _with_bucket(df, bucket)
    at_end = last or {n: F.max_by(c, F.struct(*order)) for n, c in take.items()}
    ends = b.groupBy(*keys, "_bucket").agg(*[at_end[n].alias(f"_x_{n}") for n in take])
    by_bucket = W.partitionBy(*keys).orderBy("_bucket")
    carried = ends.select(*keys, "_bucket", *[F.lag(f"_x_{n}").over(by_bucket).alias(f"_c_{n}") for n in take])
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    first = F.row_number().over(inside) == 1
    out = _rejoin(b, carried, keys).withColumns(
        {n: F.when(first, F.col(f"_c_{n}")).otherwise(F.lag(c).over(inside)) for n, c in take.items()}
    )
    return out.drop("_bucket", *[f"_c_{n}" for n in take])


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key; Spark prunes each task to ``n`` rows per key before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def nest(children: DataFrame, key: str, child: Column, spread_by: Column, name: str, part_size: int = 1000) -> DataFrame:
    """Children as arrays per key, in parts of about ``part_size`` so that no array is unbounded."""
    sizes = children.groupBy(key).agg(F.ceil(F.count("*") / part_size).alias("_parts"))
    return (
        children.join(sizes, key)
        .withColumn("part", F.pmod(F.xxhash64(spread_by), F.col("_parts")))
        .groupBy(key, "part")
        .agg(F.array_sort(F.collect_list(child)).alias(name))
    )


def first_by(df: DataFrame, key: list[str], position: Column) -> DataFrame:
    """The row of each key with the smallest position, by a partially aggregated ``min_by``."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), position).alias("_r")).select(*key, "_r.*")
