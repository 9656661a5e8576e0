"""Nested catalogue files, landing, sinks, upserts, ledgers and external payloads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import constants as K
from waymark.functions.geo import leg
from waymark.functions.stats import lookup, rnd
from waymark.sources.tables import MissingTable

PLACE_FIELDS = "struct<place:bigint,name:string,lat:double,lon:double,tags:array<string>>"
CATALOGUE_SCHEMA = f"cluster struct<circuit:bigint,center_lat:double,center_lon:double>, attractions array<{PLACE_FIELDS}>"


def read_catalogue(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """One row per place of the nested JSON files under ``path``, with the file name.

    ``whole_files``: a file is one object, indented or not; else every line is one. A folder without
    JSON files and a file that does not parse are errors, not empty results.
    """
    reader = spark.read.schema(CATALOGUE_SCHEMA).option("mode", "FAILFAST").option("multiLine", whole_files)
    try:
        raw = reader.option("pathGlobFilter", "*.json").json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise MissingTable(f"no catalogue files under {path}") from error
        raise
    if not raw.inputFiles():
        raise MissingTable(f"no catalogue files under {path}")
    return raw.select(
        F.col("_metadata.file_name").alias("source_file"), "cluster", F.explode("attractions").alias("place")
    ).select("source_file", F.col("cluster.circuit").alias("circuit"), "place.*")


def write_catalogue(places: DataFrame, path: str) -> None:
    """Places nested under their circuit; a circuit holds a bounded handful of places."""
    nested = places.groupBy("circuit").agg(
        F.avg("lat").alias("lat"),
        F.avg("lon").alias("lon"),
        F.array_sort(F.collect_list(F.struct("place", "name", F.col("lat").alias("lat"), F.col("lon").alias("lon"), "tags"))).alias("attractions"),
    )
    nested.select(
        F.struct("circuit", F.col("lat").alias("center_lat"), F.col("lon").alias("center_lon")).alias("cluster"),
        "attractions",
    ).write.mode("overwrite").json(path)


def land(rows: DataFrame, record_type: str, key: Column) -> DataFrame:
    """Bronze rows: JSON payload over name-sorted columns, its hash, one row per (key, hash)."""
    payload = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]))
    return (
        rows.select(F.lit(record_type).alias("record_type"), key.alias("record_key"), payload.alias("payload"))
        .withColumn("content_hash", F.sha2("payload", 256))
        .dropDuplicates(["record_key", "content_hash"])
    )


def sink(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Update every field on a key match, insert the rest, keep the untouched."""
    fields = [c for c in old.columns if c != key]
    joined = old.withColumn("_old", F.lit(True)).alias("o").join(
        new.withColumn("_new", F.lit(True)).alias("n"), key, "full_outer"
    )
    is_new, is_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    return joined.select(
        key,
        *[F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in fields],
        F.when(is_new & is_old, "updated").when(is_new, "inserted").otherwise("kept").alias("change"),
    )


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children of a loaded parent are replaced wholesale, the others stay."""
    return old.join(parents.select(key).distinct(), key, "left_anti").unionByName(new)


def run_ledger(runs: DataFrame) -> DataFrame:
    """Latest run per (pipeline, run_key), keeping at most twenty rejections."""
    columns = [c for c in runs.columns if c not in ("pipeline", "run_key")]
    latest = runs.groupBy("pipeline", "run_key").agg(
        F.max(F.struct("finished", "run", *[c for c in columns if c not in ("finished", "run")])).alias("r")
    )
    return latest.select("pipeline", "run_key", "r.*").withColumn("rejections", F.slice("rejections", 1, 20))


FORECAST_SCHEMA = (
    "time array<string>, weather_code array<int>, t_max array<double>, t_min array<double>, "
    "mm array<double>, prob array<double>"
)


def forecast_rows(payloads: DataFrame, key: str) -> DataFrame:
    """Parallel arrays of a daily forecast to one row per date."""
    daily = F.from_json("payload", FORECAST_SCHEMA)
    rows = payloads.select(key, daily.alias("d")).select(
        key, F.inline(F.arrays_zip("d.time", "d.weather_code", "d.t_max", "d.t_min", "d.mm", "d.prob"))
    )
    return rows.select(
        key,
        F.col("time").alias("date"),
        lookup(K.WMO_CONDITIONS, F.coalesce("weather_code", F.lit(0)), "unknown").alias("condition"),
        "t_max",
        "t_min",
        "mm",
        (F.coalesce("prob", F.lit(0.0)) / 100.0).alias("prob"),
    )


MATRIX_SCHEMA = "durations array<array<double>>, distances array<array<double>>"


def matrix_legs(payloads: DataFrame, key: str) -> DataFrame:
    """Nested duration and distance arrays to legs; ``points`` supplies missing distances."""
    parsed = payloads.select(key, "points", "mode", F.from_json("payload", MATRIX_SCHEMA).alias("m"))
    rows = parsed.select(key, "points", "mode", "m.distances", F.posexplode("m.durations").alias("i", "row"))
    cells = rows.select(key, "points", "mode", "distances", "i", F.posexplode("row").alias("j", "secs"))
    a, b = F.element_at("points", F.col("i") + 1), F.element_at("points", F.col("j") + 1)
    given = F.coalesce(F.get(F.get("distances", F.col("i")), F.col("j")), F.lit(0.0)) / 1000.0
    estimated = leg(a["lat"], a["lon"], b["lat"], b["lon"], F.col("mode"))["km"]
    return cells.select(
        key,
        "i",
        "j",
        rnd(F.coalesce("secs", F.lit(0.0)) / 60.0, 2).alias("minutes"),
        F.when(F.col("distances").isNull(), estimated).otherwise(rnd(given, 4)).alias("km"),
    )


def report(metrics: DataFrame, path: str) -> str:
    """Metric rows to JSON under ``path``/rows and to a markdown table under ``path``/table; returns ``path``.

    Both are written by tasks. The head is the first line of the first part file; a null is an empty
    cell, and a bar or a line break inside a value does not end its cell.
    """
    metrics.write.mode("overwrite").json(f"{path}/rows")
    name = lambda c: f"`{c.replace('`', '``')}`"
    value = lambda c: F.regexp_replace(F.coalesce(F.col(name(c)).cast("string"), F.lit("")), r"\R", " ")
    cell = lambda c: F.replace(value(c), F.lit("|"), F.lit("\\|"))
    lines = metrics.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in metrics.columns]), F.lit(" |")).alias("line"))
    head = "| " + " | ".join(metrics.columns) + " |\n|" + "---|" * len(metrics.columns)
    # a union keeps the order of its sides, so the head is written by the first task
    metrics.sparkSession.range(0, 1, 1, 1).select(F.lit(head).alias("line")).union(lines).write.mode("overwrite").text(f"{path}/table")
    return path
