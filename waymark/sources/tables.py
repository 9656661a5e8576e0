"""Column-pruned readers of the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


_schemas: dict[tuple[str, str], T.StructType] = {}


class MissingTable(FileNotFoundError):
    """A layer table that a job needs has not been written yet."""


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One given table; zone-less timestamps become UTC timestamps."""
    path = f"{root}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema  # footers are read once per session and table
    df = spark.read.schema(_schemas[key]).parquet(path)
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def layer(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A written layer table; a missing one is reported by name."""
    try:
        return spark.read.parquet(f"{path}/{name}")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            raise MissingTable(f"layer table '{name}' is missing under {path}; run its stage first") from error
        raise
