"""Incremental corpus ingest (SC6, §2.18): new files once each by a file stream with a checkpoint, equal texts once ever by keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.operators.retrieval import chunk, drop_reference_chunks

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started here keep their state in RocksDB, so that it is not bounded by an executor's memory."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ingest_new(spark: SparkSession, source: str, sink: str, checkpoint: str, schema, fmt: str = "parquet", papers: str | None = None, within: str | None = None, name: str | None = None, files: int = 1000) -> None:
    """Chunks of documents (doc_id, text, ...) in files that have come since the last call, to a parquet table.

    Runs until what is there is done. A text is stored once: the stream keeps the hashes it has seen under the checkpoint, so that a
    later file, call or session with an equal text adds nothing. within: hashes are forgotten so long after their file's
    time (dropDuplicatesWithinWatermark), which bounds the state; without it they are kept for good. papers: a table that gets doc_id
    and content_hash of every stored text. A batch that is repeated after a failure replaces its own partitions. files: of a micro-batch.
    """
    read = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files).load(source)
    hashed = read.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    if within:
        hashed = hashed.withColumn("_came", F.col("_metadata.file_modification_time")).withWatermark("_came", within)
        fresh = hashed.dropDuplicatesWithinWatermark(["content_hash"]).drop("_came")
    else:
        fresh = hashed.dropDuplicates(["content_hash"])

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            chunks = drop_reference_chunks(chunk(batch)).withColumn("batch", F.lit(number))
            tables = [(sink, chunks)]
            if papers:
                tables.append((papers, batch.select("doc_id", "content_hash").withColumn("batch", F.lit(number))))
            for path, table in tables:
                table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        finally:
            batch.unpersist()

    writer = fresh.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with _state_on_disk(spark):
        (writer.queryName(name) if name else writer).start().awaitTermination()
