"""Streams over the event files, checkpointed in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.stats import rate
from waymark.session import work_path

PANE = 6 * 3600
SKETCH = 400  # about 0.7 % error of rank
EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, root: str, name: str = "events.parquet", **limits: int) -> DataFrame:
    """Events as a file stream; event time is cast to a zoned timestamp so that watermarks apply.

    The table may be one file or a folder of part files; a missing table is an error, not an empty
    stream. ``limits``: source options such as maxBytesPerTrigger or maxFilesPerTrigger.
    """
    path = f"{root}/{name}"
    first = spark.read.parquet(path).select("_metadata.file_path").first()  # fails where there is no file
    reader = spark.readStream.schema(EVENT_SCHEMA).options(**limits)
    # a file stream reads folders: for a table of one file, its folder and that name
    in_root = "*" in name or first is not None and first["file_path"].endswith(f"/{name}")
    stream = reader.option("pathGlobFilter", name).parquet(root) if in_root else reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def with_field(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def append_run(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over what is there and return the sink table."""
    spark, path = stream.sparkSession, work_path(stream.sparkSession, name)
    run = (
        stream.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def update_run(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run an updating aggregate; each epoch overwrites its own folder, the latest epoch per key wins.

    Replaying an epoch after a failure rewrites the same folder, so the result stays exact.
    """
    spark, path = stream.sparkSession, work_path(stream.sparkSession, name)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/epoch={epoch}")

    run = (
        stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    written = spark.read.schema(with_field(stream.schema, "epoch", T.IntegerType())).parquet(f"{path}/table")
    rest = [c for c in stream.columns if c not in keys]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select(*keys, "r.*")


def batch_run(stream: DataFrame, handle: Callable[[DataFrame, int], None], name: str) -> None:
    """Run ``handle`` on every micro-batch."""
    path = work_path(stream.sparkSession, name)
    run = (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()


def split_run(stream: DataFrame, delay: str, write: Callable[[DataFrame, int, Column | None], None], path: str, at: str = "ts") -> DataFrame:
    """Run ``write(rows, epoch, line)`` on the rows of every micro-batch that are on time; the late table is returned.

    The line is the highest event time of the batches before, less ``delay``: a watermark that is
    written down. Rows behind it, and rows without event time, go to the late table whole, so every
    row of the stream is in one of two places. Each epoch reads the mark of the epoch before only,
    and a replayed epoch overwrites its own folders.
    """
    spark = stream.sparkSession

    def handle(batch: DataFrame, epoch: int) -> None:
        before = batch.sparkSession.read.parquet(f"{path}/marks/epoch={epoch - 1}").scalar() if epoch else F.lit(None).cast("timestamp")
        line = before - F.expr(f"interval {delay}")
        on_time = F.col(at).isNotNull() & F.coalesce(F.col(at) >= line, F.lit(True))
        write(batch.where(on_time), epoch, line)
        batch.where(~on_time).write.mode("overwrite").parquet(f"{path}/late/epoch={epoch}")
        mark = F.greatest(F.max(at), before).alias("mark")
        batch.agg(mark).write.mode("overwrite").parquet(f"{path}/marks/epoch={epoch}")

    batch_run(stream, handle, "split")
    return spark.read.schema(with_field(stream.schema, "epoch", T.IntegerType())).parquet(f"{path}/late").drop("epoch")


def count_run(stream: DataFrame, delay: str, count: Callable[[DataFrame], DataFrame], keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(counts of on-time rows, late rows). ``count`` gives keys and ``n``; each epoch adds its own part."""
    path = work_path(stream.sparkSession, name)
    shape = count(stream).schema

    def write(rows: DataFrame, epoch: int, line: Column | None) -> None:
        count(rows).write.mode("overwrite").parquet(f"{path}/parts/epoch={epoch}")

    late = split_run(stream, delay, write, path)
    parts = stream.sparkSession.read.schema(shape).parquet(f"{path}/parts")
    return parts.groupBy(*keys).agg(F.sum("n").alias("n")), late


def health_panes(calls: DataFrame) -> DataFrame:
    """Mergeable parts per service and pane of six hours; ``calls``: service, ts, ok, fallback, value."""
    pane = F.floor(F.unix_seconds("ts") / PANE) * PANE
    return calls.where("ts is not null").groupBy("service", pane.alias("pane")).agg(
        F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors"), F.count_if("fallback").alias("fallbacks"),
        F.kll_sketch_agg_double("value", F.lit(SKETCH)).alias("sketch"),
    )


def rolling_health(panes: DataFrame, panes_per_window: int = 4) -> DataFrame:
    """Windows of several panes from the parts of any number of batches: sums, and merged sketches for the 95th percentile."""
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(panes_per_window - 1)), lambda i: F.col("pane") - i * PANE))
    merged = panes.withColumn("start", starts).groupBy("service", "start").agg(
        F.sum("calls").alias("calls"), rate(F.sum("errors"), F.sum("calls")).alias("error_rate"), rate(F.sum("fallbacks"), F.sum("calls")).alias("fallback_rate"),
        F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"),
    )
    # a window without any value has an empty sketch
    p95 = F.when(F.kll_sketch_get_n_double("sketch") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(0.95)))
    return merged.select("service", F.timestamp_seconds("start").alias("start"), "calls", "error_rate", "fallback_rate", p95.alias("p95"))


def health_run(calls: DataFrame, delay: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(panes of all rows on time, late rows): each epoch writes its own panes, no window is kept as state."""
    path = work_path(calls.sparkSession, name)
    shape = health_panes(calls).schema

    def write(rows: DataFrame, epoch: int, line: Column | None) -> None:
        health_panes(rows).write.mode("overwrite").parquet(f"{path}/panes/epoch={epoch}")

    late = split_run(calls, delay, write, path)
    return calls.sparkSession.read.schema(shape).parquet(f"{path}/panes").select(shape.names), late


def unique_run(stream: DataFrame, delay: str, key: str, name: str, at: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(first row of each key, late rows). A key is known for as long as its row is on time.

    Of the rows of a key in one micro-batch the first by event time stays, ties by the whole row.
    """
    path = work_path(stream.sparkSession, name)
    stored = with_field(stream.schema, "epoch", T.IntegerType())
    rest = [at, *[c for c in stream.columns if c not in (key, at)]]

    def write(rows: DataFrame, epoch: int, line: Column | None) -> None:
        fresh = rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*").select(*stream.columns)
        if epoch:
            held = rows.sparkSession.read.schema(stored).parquet(f"{path}/table").where((F.col("epoch") < epoch) & F.coalesce(F.col(at) >= line, F.lit(True)))
            fresh = fresh.join(held.select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/table/epoch={epoch}")

    late = split_run(stream, delay, write, path, at)
    return stream.sparkSession.read.schema(stored).parquet(f"{path}/table").drop("epoch"), late


def trailing_requests(events: DataFrame, key: str, seconds: int, limit: int) -> DataFrame:
    """Exact count per request over the preceding ``seconds``, with over-limit flag and retry-after.

    Times of a key are points with a count. Before the first row of a point's window stands a mark: running
    counts at the point and at its mark differ by the rows of the window, and the next point from the mark on is
    its first. A point only needs points of its own and the previous time bucket, so every point is also sent to the
    next bucket: a busy key is split over time. All frames begin at the partition's edge and grow, so the work
    follows the rows however many a window holds.
    """
    span = seconds * 1_000_000
    taken = {c.lower() for c in events.columns} | {"hits", "over", "retry_after"}
    own_key, own_at, stamped = "_k", "_at", events
    while {own_key, own_at} & taken:
        own_key, own_at = "_" + own_key, "_" + own_at
    stamped = events.withColumns({own_key: F.col(key), own_at: F.unix_micros("ts")}).where(F.col(own_at).isNotNull())
    points = stamped.groupBy(F.col(own_key).alias("k"), F.col(own_at).alias("at")).agg(F.count("*").alias("n"))
    b = F.floor(F.col("at") / span)
    entry = lambda bucket, t, kind, n: F.struct(bucket.alias("b"), t.alias("t"), F.lit(kind).alias("kind"), n.alias("n"))
    entries = points.select("k", "at", F.inline(F.array(
        entry(b, F.col("at"), 1, F.col("n")), entry(b + 1, F.col("at"), 2, F.col("n")), entry(b, F.col("at") - span, 0, F.lit(0).cast("long")),
    )))
    forward = W.partitionBy("k", "b").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    backward = W.partitionBy("k", "b").orderBy(F.desc("t"), F.desc("kind")).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = entries.withColumns({"upto": F.sum("n").over(forward), "next": F.min(F.when(F.col("kind") > 0, F.col("t"))).over(backward)}).where("kind < 2")
    windows = run.groupBy("k", "b", "at").agg(
        (F.max(F.when(F.col("kind") == 1, F.col("upto"))) - F.max(F.when(F.col("kind") == 0, F.col("upto")))).alias("hits"),
        F.max(F.when(F.col("kind") == 0, F.col("next"))).alias("first"),
    ).select(F.col("k").alias("_point_k"), F.col("at").alias("_point_at"), "hits", F.col("first").alias("_first"))
    counted = stamped.join(windows, F.col(own_key).eqNullSafe(F.col("_point_k")) & (F.col(own_at) == F.col("_point_at")))
    wait = F.round((F.col("_first") + span - F.col("_point_at")) / 1e6, 1)
    return counted.withColumns({
        "over": F.col("hits") > limit, "retry_after": F.when(F.col("hits") > limit, F.greatest(F.lit(0.0), wait)).otherwise(0.0)
    }).drop(own_key, own_at, "_point_k", "_point_at", "_first")
