"""Written intermediate tables in the cluster's shared folder, and small frame helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder of a local session (tests), and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="assaygrid-")
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/assaygrid/{name}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def arrow_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bounds the rows of an Arrow batch, so that long texts do not add up in a Python worker.

    The bound is the session's, for plans run later than they are made; it is only ever lowered.
    """
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that a result of the operator would clash with (names ignore case)."""
    clash = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in clash])
