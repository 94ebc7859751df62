"""Activity by window (§2.18): tumbling windows by kind and sessions by user, of tables and of streams with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.streaming.ingest import _state_on_disk


def windowed_activity(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, kind, n and total by window and kind; a stream waits for rows up to late behind the latest."""
    return _grouped(events, F.window(time, width), [kind], time, value, late).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, time: str = "ts", user: str = "user_id", value: str = "value", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user, start, end (gap after the last row), n and total of each session: rows of a user with less than gap between them."""
    return _grouped(events, F.session_window(time, gap), [user], time, value, late).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def _grouped(events: DataFrame, window, by: list[str], time: str, value: str, late: str) -> DataFrame:
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    stamped = stamped.withWatermark(time, late) if stamped.isStreaming else stamped
    return stamped.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def run_activity(spark: SparkSession, source: str, sink: str, checkpoint: str, schema, of=windowed_activity, files: int = 1000, **how: str) -> DataFrame:
    """Windows of the events in files that have come since the last call, appended to a parquet table once each is closed.

    of: windowed_activity or sessions, with its arguments. A window is closed when the latest row is late beyond its end; what
    comes for it after that is dropped. Windows that are still open stay in the state under the checkpoint for the next call; close_windows()
    ends a stream of events.
    """
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    with _state_on_disk(spark):
        of(read, **how).writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(of(spark.createDataFrame([], schema), **how).schema).parquet(sink)


def close_windows(spark: SparkSession, source: str, schema, time: str = "ts", after: str = "10 years") -> None:
    """Adds a row so long after the latest one that the next call closes every window; its own stays open."""
    events = spark.read.schema(schema).parquet(source)
    last = events.agg(F.max(time).alias(time)).where(F.col(time).isNotNull())
    blank = [(F.col(time) + F.expr(f"INTERVAL {after}")).cast(f.dataType).alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields]
    last.select(*blank).coalesce(1).write.mode("append").parquet(source)
