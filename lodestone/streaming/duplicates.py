"""An extension without a counterpart among the audit operators: streams of events.

State is kept for the time of the watermark only: windows are updated until it has
passed them, keys are forgotten after it.  Rows leave through a file sink, not
through the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir


def distinct_events(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, by: str, time: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums by window; a window is final when the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def drain(spark: SparkSession, out: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what there is and return its rows; with `keys` (mode update) the last row of each.

    A batch is a folder of its own, written over if the batch is run again, so that
    a restart gives no row twice.
    """
    if (mode == "update") != bool(keys):
        raise ValueError("rows that are updated need keys, others have none")
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")

    query = out.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    # A stream without input has no batch.
    spark.createDataFrame([], out.schema).write.mode("overwrite").parquet(f"{root}/rows/batch=-1")
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in out.schema)}, batch bigint").parquet(f"{root}/rows")
    if not keys:
        return rows.select(out.columns)
    last = rows.groupBy(*keys).agg(F.max(F.struct("batch", *[c for c in out.columns if c not in keys])).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in out.columns])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # As a pattern: a stream takes a folder or a pattern, and the table may be one file.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, through a stream over the events table."""
    counts = windowed_counts(_events(spark, sf_dir).select("ts", "event_type", "value"), "event_type")
    out = drain(spark, counts, "update", ["window", "event_type"])
    return out.select(F.col("window.start").cast("date").alias("day"), "event_type", "n", "total")


def daily_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many users had an event of each type on each day: one event for each of them, through a stream with state of a day."""
    day = _events(spark, sf_dir).select(F.date_trunc("day", "ts").alias("ts"), "user_id", "event_type")
    first = drain(spark, distinct_events(day, ["ts", "user_id", "event_type"], late="1 day"))
    return first.groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n_users"))
