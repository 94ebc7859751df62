"""Queries that run as streams to the end, each held against SQL over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.plans.registry import query, table
from assaygrid.plans.tabular import r6
from assaygrid.shared import fresh_path
from assaygrid.streaming import activity, ingest, progress

#: Batches of files that a table is fed in.
FILES = 3


def _fed_documents(spark: SparkSession, sf_dir: str, name: str | None = None) -> str:
    """Ingests all documents in three batches of files, each by a stream started anew; the last one repeats texts of the first under other ids.

    A batch has a file a partition of the table as it is read, so no task holds more of it than that.
    """
    base = fresh_path(spark, "ingest")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    again = d.where("doc_id % 3 = 0").withColumn("doc_id", -F.col("doc_id") - 1)
    for k in range(FILES):
        part = d.where(F.col("doc_id") % FILES == k)
        (part.unionByName(again) if k == FILES - 1 else part).write.mode("append").parquet(f"{base}/in")
        ingest.ingest_new(spark, f"{base}/in", f"{base}/chunks", f"{base}/state", d.schema, papers=f"{base}/papers", name=name, files=1_000_000)
    return base


@query("SELECT sha256(coalesce(text, '')) AS content_hash, 1 AS n_stored FROM documents GROUP BY 1")
def ingest_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each text of three calls is stored, whatever file and call it came in."""
    base = _fed_documents(spark, sf_dir)
    return spark.read.parquet(f"{base}/papers").groupBy("content_hash").agg(F.count("*").cast("int").alias("n_stored"))


@query("SELECT 'batches' AS what, 3 AS n UNION ALL SELECT 'rows', count(*) + count(*) FILTER (WHERE doc_id % 3 = 0) FROM documents UNION ALL SELECT 'done', 1 UNION ALL SELECT 'estimates in order', 1")
def ingest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of progress for each micro-batch of the three calls, and one at the end."""
    d = table(spark, sf_dir, "documents")
    path = fresh_path(spark, "progress")
    with progress.ProgressLog(spark, "ingest", path, d.count() + d.where("doc_id % 3 = 0").count()):
        _fed_documents(spark, sf_dir, "ingest")
    log = progress.progress(spark, path)
    counts = log.agg(F.count("batch").alias("batches"), F.sum("rows_in").alias("rows"), F.count_if("done").alias("done"), (F.count_if(F.col("pct") < 100) == F.count("batch")).cast("long").alias("estimates in order"))
    names = counts.columns
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(f"`{c}`").alias("n")) for c in names])).alias("x")).select("x.*")


def _fed_events(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Events in files by time, one after the other; a row may come up to ten minutes behind later ones, so in the next file."""
    base = fresh_path(spark, "events")
    e = table(spark, sf_dir, "events")
    e = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    low, high = e.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    width = (high - low) // FILES + 1
    jitter = F.pmod(F.xxhash64("event_id"), F.lit(600_000_000))
    place = F.floor((F.unix_micros("ts") + jitter - F.lit(low)) / width)
    for k in range(FILES + 1):
        e.where(place == k).orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(f"{base}/in")
    activity.close_windows(spark, f"{base}/in", e.schema)
    return base, e


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2")
def streamed_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of events that come out of order, file by file, in append mode."""
    base, e = _fed_events(spark, sf_dir)
    w = activity.run_activity(spark, f"{base}/in", f"{base}/out", f"{base}/state", e.schema, files=1)
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r6(F.col("total"), 4).alias("total"))


@query("""
WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM s GROUP BY user_id, k
""")
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users whose events come out of order, merged across files in the state."""
    base, e = _fed_events(spark, sf_dir)
    w = activity.run_activity(spark, f"{base}/in", f"{base}/out", f"{base}/state", e.schema, of=activity.sessions, files=1)
    return w.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", r6(F.col("total"), 4).alias("total"))
