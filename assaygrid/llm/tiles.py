"""Self-joins inside buckets of any size: own rows against all rows, dealt in tiles of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets beyond a tile, of which a broadcast table may hold so many; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
KEY = ["bucket", "tile", "run"]


def deal(keyed: DataFrame, by: str, tile: int, length: int | None = None, members: DataFrame | None = None) -> DataFrame:
    """keyed (bucket, own, by, ...) with tile, run and side, partitioned and sorted by them.

    A bucket of n own rows has ceil(n / tile) tiles of them (side 0); all its rows lie in runs of about
    length (tile by default; side 1), and each tile meets each run in one group. A row is copied once a
    tile or run, so both are as large as a task's memory allows. by: a column that spreads a bucket's rows.
    members: keyed's bucket and own, where they are had for less.
    """
    sizes = (keyed if members is None else members).groupBy("bucket").agg(F.count_if("own").alias("own_n"), F.count("*").alias("all_n"))
    length = length or tile
    large = sizes.where(f"own_n > {tile} or all_n > {length}").select("bucket", F.greatest(F.ceil(F.col("own_n") / tile), F.lit(1)).cast("int").alias("tiles"), F.ceil(F.col("all_n") / length).cast("int").alias("runs"))
    few = len(large.limit(BROADCAST_ROWS + 1).take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS
    placed = keyed.join(F.broadcast(large) if few else large, "bucket", "left")
    tiles, runs = F.coalesce("tiles", F.lit(1)), F.coalesce("runs", F.lit(1))
    mine = F.struct(F.pmod(F.xxhash64(by), tiles).cast("int").alias("tile"), F.lit(0).alias("side"))
    at = F.pmod(F.xxhash64(by, F.lit(1)), runs).cast("int")
    own = F.when(F.col("own"), F.transform(F.sequence(F.lit(0), runs - 1), lambda r: F.struct(mine["tile"].alias("tile"), r.alias("run"), F.lit(0).alias("side"))))
    every = F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(t.alias("tile"), at.alias("run"), F.lit(1).alias("side")))
    dealt = placed.withColumn("to", F.explode(F.concat(F.coalesce(own, F.array().cast("array<struct<tile:int,run:int,side:int>>")), every)))
    columns = [F.col(c) for c in keyed.columns if c != "own"]
    return dealt.select(*columns, "to.tile", "to.run", "to.side").repartition(*KEY).sortWithinPartitions(*KEY, "side")


def grouped(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows of whole groups, where each group begins, its number of own rows) of a partition that deal() sorted."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        heads = _heads(table)
        if len(heads) > 1:
            cut = int(heads[-1])
            yield table.slice(0, cut), heads[:-1], _owns(table.slice(0, cut), heads[:-1])
            table = table.slice(cut)
        held, count = table.to_batches(), table.num_rows
    if count:
        table = pa.Table.from_batches(held).combine_chunks()
        heads = _heads(table)
        yield table, heads, _owns(table, heads)


def _heads(table: pa.Table) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for name in KEY:
        x = table[name].to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def _owns(table: pa.Table, heads: np.ndarray) -> np.ndarray:
    return np.add.reduceat(1 - table["side"].to_numpy().astype(np.int64), heads)
