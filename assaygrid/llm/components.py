"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.llm.tables import remove, written

#: Edge lists of so many edges are finished in one task (16 bytes an edge); longer ones go on by rounds of joins.
FINISH = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node of the edges (a, b: long) with the least node it reaches.

    Each round links every node's larger neighbours to its least one, then its smaller ones; edges
    shrink to stars around the least nodes in about log(n) rounds. A node with very many neighbours
    costs a partial aggregate and a join that adaptive execution splits; joins are by sorting, as broadcasts
    of every round would add up on the driver. Once at most FINISH edges are left, one task finishes them.
    Rounds end in written tables, so a lost executor repeats one round at most. Loops and repeated edges do no harm.
    """
    spark = edges.sparkSession
    start = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    now, path = written(start, "edges")
    stamp = _stamp(now)
    while stamp[0] > FINISH:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower.hint("merge"), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now, fresh = written(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "edges")
        remove(spark, path)
        path, before, stamp = fresh, stamp, _stamp(now)
        if stamp == before:
            break
    if 0 < stamp[0] <= FINISH:
        now, fresh = written(now.repartition(1).mapInArrow(_stars, "a long, b long"), "edges")
        remove(spark, path)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stamp(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(r)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all edges of a partition: each node but the least of its component, with that least one."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    edges = np.stack([table["a"].to_numpy(), table["b"].to_numpy()])
    names, at = np.unique(edges, return_inverse=True)
    a, b = at.reshape(2, -1)
    root = local_forest(len(names), a, b)
    node = np.flatnonzero(root != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[node]), pa.array(names[root[node]])], ["a", "b"])


def local_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the edges a-b among 0..n-1, each node's least reachable one: what a task need pass on."""
    root = np.arange(n)
    if not len(a):
        return root
    while True:
        low = np.minimum(root[a], root[b])
        fresh = root.copy()
        np.minimum.at(fresh, root[a], low)
        np.minimum.at(fresh, root[b], low)
        while True:
            hop = fresh[fresh]
            if (hop == fresh).all():
                break
            fresh = hop
        if (fresh == root).all():
            return root
        root = fresh
