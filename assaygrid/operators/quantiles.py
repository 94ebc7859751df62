"""Exact quantiles of many columns at once by repeated histograms.

A number's bits, the sign turned round, order as the numbers do. A pass counts the values of all columns by the next BITS of
their bits, of those alone that share the bits known so far with a rank that is looked for; tasks pass on a row for each
bin they met. After a pass each rank's bin is known; it is done when the bin's least and greatest value agree, and after 64 bits at the latest. So no buffer grows with the rows or with
the different values, and the number of passes does not depend on the number of columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.shared import remove, written

#: Bits of a pass: a task holds up to 2 ** BITS bins for each column and rank.
BITS = 16
_TOP = np.uint64(1 << 63)


def ordered_bits(v: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of v (float64 without NaN); zeros of either sign are one."""
    u = (v + 0.0).view(np.uint64)
    return np.where(u & _TOP, ~u, u | _TOP)


def _binned(wanted: dict[int, list[int]], known: int):
    """(column, prefix, bin, n, low, high) of a task's values; wanted: of each column the prefixes of so many known bits."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], list] = {}
        shift = np.uint64(64 - known - BITS)
        for batch in batches:
            for c, prefixes in wanted.items():
                v = batch.column(c).to_numpy(zero_copy_only=False).astype(float)
                v = v[~np.isnan(v)]
                u = ordered_bits(v)
                if known:
                    head = u >> np.uint64(64 - known)
                    ok = np.isin(head, np.array(prefixes, np.uint64))
                    u, v = u[ok], v[ok]
                if not len(u):
                    continue
                order = np.argsort(u)
                key, v = (u >> shift)[order], v[order]
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                ends = np.append(at[1:], len(key))
                for k, n, low, high in zip(key[at].tolist(), (ends - at).tolist(), v[at].tolist(), v[ends - 1].tolist(), strict=True):
                    place = (c, k >> BITS, k & ((1 << BITS) - 1))
                    held = total.get(place)
                    if held is None:
                        total[place] = [n, low, high]
                    else:
                        held[0] += n
                        held[1] = min(held[1], low)
                        held[2] = max(held[2], high)
        # prefixes as signed numbers, which hold the same bits
        rows = [(c, p - (1 << 64) if p >= 1 << 63 else p, b, *x) for (c, p, b), x in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["c", "prefix", "bin", "n", "low", "high"])

    return counted


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], linear: bool = True) -> dict[str, list[float | None]]:
    """For each column its quantiles, linear between the two values around a rank, as median() and percentile() have them; or else the lower of the two.

    Nulls and NaN are left out; a column without values has no quantiles (None). Columns are read as doubles. Two passes
    where values have few digits, four at most.
    """
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    found: dict[tuple[int, int], float] = {}
    ranks: dict[int, list[int]] = {}
    open_: list[tuple[int, int, int]] = []  # column, prefix, rank inside the prefix; its rank in the column by the same place in names
    names: list[tuple[int, int]] = []
    wanted = {i: [0] for i in range(len(columns))}
    sizes: dict[int, int] = {}
    for known in range(0, 64, BITS):
        parts = rows.mapInArrow(_binned(wanted, known), "c int, prefix long, bin long, n long, low double, high double")
        bins, path = written(parts.groupBy("c", "prefix", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")), "bins")
        if not known:
            sizes = {r["c"]: r["n"] for r in bins.groupBy("c").agg(F.sum("n").alias("n")).collect()}  # a row a column
            for c, n in sizes.items():
                ranks[c] = sorted({f(p * (n - 1)) for p in probabilities for f in ((math.floor, math.ceil) if linear else (math.floor,))})
            names = [(c, k) for c in ranks for k in ranks[c]]
            open_ = [(c, 0, k) for c, k in names]
        if not open_:
            remove(df.sparkSession, path)
            break
        asked = df.sparkSession.createDataFrame([(i, c, p - (1 << 64) if p >= 1 << 63 else p, k) for i, (c, p, k) in enumerate(open_)], "i int, _c int, _p long, k long")
        running = Window.partitionBy("c", "prefix").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        counted = bins.withColumn("upto", F.sum("n").over(running))
        hit = counted.join(F.broadcast(asked), (F.col("c") == F.col("_c")) & (F.col("prefix") == F.col("_p")) & (F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("n")))
        following, still, wanted = [], [], {}
        for r in hit.collect():  # a row a rank
            place = names[r["i"]]
            if r["low"] == r["high"]:
                found[place] = r["low"] + 0.0
                continue
            prefix = (open_[r["i"]][1] << BITS) | r["bin"]
            following.append((r["c"], prefix, r["k"] - (r["upto"] - r["n"])))
            still.append(place)
            wanted.setdefault(r["c"], [])
            if prefix not in wanted[r["c"]]:
                wanted[r["c"]].append(prefix)
        remove(df.sparkSession, path)
        open_, names = following, still
        if not open_:
            break
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        if i not in sizes:
            out[c] = [None] * len(probabilities)
            continue
        out[c] = []
        for p in probabilities:
            at = p * (sizes[i] - 1)
            low = found[i, math.floor(at)]
            high = found[i, math.ceil(at)] if linear else low
            out[c].append(low if low == high else low + (at - math.floor(at)) * (high - low))
    return out
