"""Rollups that follow their tables (§2.21): partial aggregates by run and round, written anew for runs that changed alone.

A version is a folder with the rows of the runs that it changed; a run's rows are those of the newest version that names it.
Inserts are added to what is stored, since counts, sums and maxima can be; runs that are deleted, or whose models are
changed in place, are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.shared import fresh_path, remove

#: What is kept of a group: averages are made of sums when they are read.
KEPT = {"n_models": "sum", "n_passed": "sum", "n_match": "sum", "sum_match": "sum", "max_r2": "max"}
SCHEMA = "run_id string, round int, n_models long, n_passed long, n_match long, sum_match double, max_r2 double, gone boolean, version long"


def partials(hypotheses: DataFrame, models: DataFrame, validations: DataFrame) -> DataFrame:
    """Of each run and round: counts, sums and the greatest R2 of its models."""
    joined = hypotheses.select(F.col("id").alias("hypothesis_id"), F.col("run_id").cast("string").alias("run_id"), F.col("round").cast("int").alias("round"))
    joined = joined.join(models.select(F.col("id").alias("model_result_id"), "hypothesis_id", "match_score", "r_squared"), "hypothesis_id")
    joined = joined.join(validations.select("model_result_id", "overall_passed"), "model_result_id", "left")
    return joined.groupBy("run_id", "round").agg(
        F.count("*").alias("n_models"),
        F.count_if("overall_passed").alias("n_passed"),
        F.count("match_score").alias("n_match"),
        F.sum(F.col("match_score").cast("double")).alias("sum_match"),
        F.max(F.col("r_squared").cast("double")).alias("max_r2"),
    )


class Rollup:
    """The stored convergence of runs under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """The numbers of the versions that are complete."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        store = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(top):
            return []
        names = [(s.getPath(), s.getPath().getName()) for s in store.listStatus(top)]
        return sorted(int(n.removeprefix("version=")) for p, n in names if n.startswith("version=") and store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _stored(self) -> DataFrame:
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], SCHEMA)
        paths = [f"{self.path}/version={v}" for v in found]
        return self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(*paths)

    def _current(self) -> DataFrame:
        rows = self._stored()
        newest = rows.groupBy(F.col("run_id").alias("_run")).agg(F.max("version").alias("_version"))
        return rows.join(newest, rows["run_id"].eqNullSafe(newest["_run"]) & (rows["version"] == newest["_version"])).where("not gone").select("run_id", "round", *KEPT)

    def _put(self, rows: DataFrame) -> int:
        version = max(self.versions(), default=0) + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/version={version}")
        return version

    def replace(self, rows: DataFrame, runs: DataFrame) -> int:
        """The rows of the runs (run_id) are these from now on; runs without any are gone."""
        named = runs.select(F.col("run_id").cast("string").alias("_run")).distinct()
        mine = rows.join(named, rows["run_id"].eqNullSafe(named["_run"]), "left_semi")
        marks = named.join(mine.select("run_id").distinct(), F.col("_run").eqNullSafe(F.col("run_id")), "left_anti")
        gone = marks.select(F.col("_run").alias("run_id"), F.lit(None).cast("int").alias("round"), *[F.lit(None).cast("double" if k in ("sum_match", "max_r2") else "long").alias(k) for k in KEPT], F.lit(True).alias("gone"))
        return self._put(mine.select("run_id", "round", *KEPT, F.lit(False).alias("gone")).unionByName(gone))

    def insert(self, rows: DataFrame) -> int:
        """Adds the partials of new models to what their runs have."""
        runs = rows.select("run_id").distinct()
        before = self._current()
        old = before.join(runs.withColumnRenamed("run_id", "_run"), before["run_id"].eqNullSafe(F.col("_run")), "left_semi")
        both = old.unionByName(rows.select("run_id", "round", *KEPT))
        merged = both.groupBy("run_id", "round").agg(*[(F.sum if how == "sum" else F.max)(k).alias(k) for k, how in KEPT.items()])
        return self._put(merged.withColumn("gone", F.lit(False)))

    def delete(self, runs: DataFrame) -> int:
        """Runs that are no more."""
        return self.replace(self._current().limit(0), runs)

    def read(self) -> DataFrame:
        """run_id, round, avg_match, max_r2, n_models and n_passed, as the full query gives them."""
        return self._current().select("run_id", "round", F.try_divide("sum_match", "n_match").alias("avg_match"), "max_r2", "n_models", "n_passed")

    def compact(self) -> int:
        """One version in the place of all: readers of older ones keep them until it is complete."""
        before = self.versions()
        staged = fresh_path(self.spark, "rollup")
        self._current().withColumn("gone", F.lit(False)).write.parquet(staged)
        version = self._put(self.spark.read.parquet(staged))
        for v in before:
            remove(self.spark, f"{self.path}/version={v}")
        remove(self.spark, staged)
        return version
