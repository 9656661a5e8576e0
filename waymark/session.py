"""Session settings and shared work folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MANY = 400  # parts that a shuffle of ``cut_in_parts`` starts with; adaptive execution joins small ones


def tune(spark: SparkSession) -> SparkSession:
    """Apply the session settings every job here relies on."""
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Root for checkpoints and intermediate tables: the folder the cluster names."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="waymark-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/waymark/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Materialise to the shared folder and read back: ends the lineage, survives executor loss."""
    path = work_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def cut_and_free(df: DataFrame, name: str = "cut") -> DataFrame:
    """``cut`` of much data: packed tightly, and the shuffle files of its making go as soon as it is written."""
    conf, path = df.sparkSession.conf, work_path(df.sparkSession, name)
    before = conf.get(FREE, None)
    conf.set(FREE, "true")
    try:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    finally:
        conf.unset(FREE) if before is None else conf.set(FREE, before)
    return df.sparkSession.read.parquet(path)


def cut_in_parts(df: DataFrame, name: str = "cut") -> DataFrame:
    """``cut`` whose shuffles start with many parts: of a small fixed number, each would grow with the input."""
    conf = df.sparkSession.conf
    before = conf.get(PARTS, None)
    conf.set(PARTS, str(max(MANY, int(conf.get("spark.sql.shuffle.partitions")), int(before or 0))))
    try:
        return cut(df, name)
    finally:
        conf.unset(PARTS) if before is None else conf.set(PARTS, before)
