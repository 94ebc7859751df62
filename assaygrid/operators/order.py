"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaygrid.shared import written

#: Ranges that rows are dealt to; None: as many as the session's shuffle partitions.
RANGES: int | None = None


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with name (long): 0, 1, 2 ... in the order of the columns, nulls first; rows of equal keys in any order.

    Rows are dealt to as many ranges as the session has shuffle partitions, by their keys and then by a hash of the row, so
    that a key that many rows share is cut too; they are sorted inside ranges and written, and a range starts where
    those before it end. df is read twice (borders, rows) and what follows reads the written table, so the numbers stay the
    same. Only rows that are equal in every column lie together. An empty table stays empty.
    """
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not _holds_map(f.dataType)]
    keys = [*(F.col(f"`{c}`").asc_nulls_first() for c in order), F.col("_mark")]
    marked = df.withColumn("_mark", F.xxhash64(*plain))
    ranged = marked.repartitionByRange(RANGES, *keys) if RANGES else marked.repartitionByRange(*keys)
    rows, _ = written(ranged.sortWithinPartitions(*keys).drop("_mark").withColumn("_at", F.monotonically_increasing_id()), "ranges")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))
    placed = rows.join(F.broadcast(starts), "_part")  # a row a range
    return placed.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_start")


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _holds_map(kind.elementType)


def numbered_as_read(df: DataFrame, name: str) -> DataFrame:
    """df, as a reader of files gives it, with name (long): 0, 1, 2 ... in the order of its files and their lines.

    Rows are counted a partition, and each partition begins where those before it end: two passes, no shuffle of rows.
    """
    at = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    counts = sorted((r["_part"], r["n"]) for r in at.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a row a partition
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    if not starts:
        return at.withColumn(name, F.col("_at")).drop("_at", "_part")
    table = F.from_json(F.lit(json.dumps({str(p): s for p, s in starts})), "map<string,long>")
    return at.withColumn(name, F.element_at(table, F.col("_part").cast("string")) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part")


def in_blocks(df: DataFrame, at: str, block: int, halo: int) -> DataFrame:
    """df, numbered by at, with b: the block of so many rows that a row is in; its last halo rows stand in the next block too."""
    own = F.floor(F.col(at) / block)
    return df.withColumn("b", F.explode(F.when(F.col(at) >= (own + 1) * block - halo, F.array(own, own + 1)).otherwise(F.array(own))))
