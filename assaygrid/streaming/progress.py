"""Progress of running streams (§2.18): a row for every micro-batch, with an estimate of what is left."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "job string, batch long, rows_in long, rows_so_far long, seconds double, pct int, eta_seconds int, done boolean, error string"


def eta_seconds(pct: int, elapsed: float, done: bool = False) -> int | None:
    """Seconds left at the rate so far, one at least; nothing up to 5 % or once it is done."""
    if done or pct <= 5 or elapsed <= 0:
        return None
    return max(1, int((100 - pct) * elapsed / pct))


class ProgressLog(StreamingQueryListener):
    """Appends a row for each micro-batch of queries of a name to a JSON table, and one when such a query ends.

    total_rows: rows that the job has in all, for pct; without it pct is 0 until the end. Use as a context manager around the runs of a
    job: what the listener still has to hear of is waited for at the end.
    """

    def __init__(self, spark: SparkSession, job: str, path: str, total_rows: int | None = None, wait: float = 30.0):
        self.spark, self.job, self.path, self.total, self.wait = spark, job, path, total_rows, wait
        self.rows_so_far = 0
        self.began = time.time()
        self._names: dict[str, str] = {}
        self._ended = threading.Condition()
        self._open = 0
        self._seen: set[tuple[str, int]] = set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.job:
            with self._ended:
                self._names[str(event.runId)] = event.name
                self._open += 1

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        key = (str(p.runId), p.batchId)
        # a batch without rows moves the watermark only
        if p.name != self.job or not p.numInputRows or key in self._seen:
            return
        self._seen.add(key)
        self.rows_so_far += p.numInputRows
        pct = min(99, 100 * self.rows_so_far // self.total) if self.total else 0
        self._write(p.batchId, p.numInputRows, p.batchDuration / 1000, pct, eta_seconds(pct, time.time() - self.began), False, None)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.runId) in self._names:
            with self._ended:
                self._open -= 1
                self._ended.notify_all()

    def _write(self, batch: int | None, rows: int, seconds: float, pct: int, eta: int | None, done: bool, error: str | None) -> None:
        row = (self.job, batch, rows, self.rows_so_far, float(seconds), int(pct), eta, done, error)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").json(self.path)

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, kind, error, trace) -> None:
        with self._ended:
            self._ended.wait_for(lambda: self._open <= 0, self.wait)
        self.spark.streams.removeListener(self)
        self._write(None, 0, time.time() - self.began, 100 if error is None else 0, None, error is None, str(error)[:200] if error else None)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """The rows written so far, in order: the last one tells where a job is."""
    return spark.read.schema(SCHEMA).json(path)
