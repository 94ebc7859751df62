"""Every row of one table against every row of another: tiles of both meet in groups of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups are dealt to so many tasks at most.
TASKS = 10_000


def met(left: DataFrame, right: DataFrame, by: str, left_tile: int, right_tile: int) -> DataFrame:
    """Rows of both (the same columns) with cell and side (0: left), dealt so that each cell lies in one task, its left rows first.

    A side of n rows has ceil(n / tile) tiles, and a row is dealt to one of them by the hash of column by; each pair of a left
    and a right tile is a cell. So a left row is copied once for each right tile, and the other way round: nothing is
    collected or broadcast, and a cell holds two tiles. by: a column that tells rows apart.
    """
    tiles = [max(1, -(-df.select(by).count() // size)) for df, size in ((left, left_tile), (right, right_tile))]
    at = [F.pmod(F.xxhash64(by, F.lit(side)), F.lit(n)) for side, n in enumerate(tiles)]
    every = [F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("long")) for n in tiles]
    cells = [F.transform(every[1], lambda j: at[0] * tiles[1] + j), F.transform(every[0], lambda i: i * tiles[1] + at[1])]
    parts = [df.withColumn("cell", F.explode(c)).withColumn("side", F.lit(side)) for side, (df, c) in enumerate(zip((left, right), cells, strict=True))]
    both = parts[0].unionByName(parts[1])
    tasks = min(tiles[0] * tiles[1], TASKS)
    # by number, so that few cells still go to as many tasks
    return both.repartitionById(tasks, F.pmod(F.col("cell"), F.lit(tasks)).cast("int")).sortWithinPartitions("cell", "side")


def cells(batches: Iterator[pa.RecordBatch], held: int = 20_000) -> Iterator[tuple[pa.Table, pa.Table]]:
    """(left rows, right rows) of each cell of a task."""
    waiting: list[pa.RecordBatch] = []
    rows = 0

    def whole(table: pa.Table, last: bool) -> tuple[list[tuple[pa.Table, pa.Table]], pa.Table]:
        cell, side = table["cell"].to_numpy(), table["side"].to_numpy()
        out, start = [], 0
        heads = [*(i + 1 for i in (cell[1:] != cell[:-1]).nonzero()[0].tolist()), *([table.num_rows] if last else [])]
        for end in heads:
            split = start + int((side[start:end] == 0).sum())
            out.append((table.slice(start, split - start), table.slice(split, end - split)))
            start = end
        return out, table.slice(start)

    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= held:
            done, rest = whole(pa.Table.from_batches(waiting).combine_chunks(), False)
            yield from done
            waiting, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield from whole(pa.Table.from_batches(waiting).combine_chunks(), True)[0]
