"""Sessions with the settings that the operators expect: ANSI casts, UTC, adaptive execution."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "assaygrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session; on a cluster leave master and the number of shuffle partitions to the submitter."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        cores = os.cpu_count() or 4
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(cores)).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
