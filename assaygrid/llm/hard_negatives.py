"""Hard-negative mining by rotated one-bit codes.

Every vector's components become whole numbers. An index stores, for each vector: the numbers; its rotation's signs as
bits, those of what the signs leave, and so on (LEVELS codes); how far the vector is aligned with each code; and the
length of what all codes up to each leave. An anchor's inner product with a code is a sum of popcounts over the planes of
the anchor's rotated and rounded components. With the alignments it estimates the inner product with the vector, and by
Cauchy-Schwarz the estimate is off by no more than the anchor's length times the vector's rest, plus the length of the
anchor's rounding times the coded part's length. Pairs whose interval reaches neither the k best so far nor any wanted band are left
out; the others are scored in whole numbers.

Anchors meet rows in tiles of both, dealt by number, so no side goes through the driver or is broadcast, and no label is
too frequent. A task keeps k rows an anchor, and a window that limits groups before its shuffle keeps k of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.llm import ragged
from assaygrid.llm.tables import arrow_batches, written
from assaygrid.llm.tiles import deal, grouped

#: Codes of a vector, planes of an anchor.
LEVELS, PLANES = 3, 6
#: Anchors and rows that meet in one group; and of these at a time.
TILE, RUN = 8192, 4096
ANCHORS, ROWS = 64, 2048
#: Relative room for the rounding of rotations in double precision.
ROOM = 1e-9
#: A null id comes after all others.
_LAST = np.iinfo(np.int64).max


def rotation(width: int, seed: int = 20) -> np.ndarray:
    """An orthogonal matrix of the next multiple of 64 columns."""
    size = max(64, -(-width // 64) * 64)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q[:width]


def codes(turned: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rotated vectors: bits (levels, words, n), alignments, lengths of the rests and of the coded parts (levels, n each)."""
    rest, coded = turned.copy(), np.zeros_like(turned)
    bits, along, left, length = [], [], [], []
    for _ in range(levels):
        sign = rest >= 0
        a = np.abs(rest).mean(1)
        step = np.where(sign, a[:, None], -a[:, None])
        rest, coded = rest - step, coded + step
        bits.append(np.packbits(sign, axis=1, bitorder="little").view("<u8").T)
        along.append(a)
        left.append(np.sqrt((rest * rest).sum(1)))
        length.append(np.sqrt((coded * coded).sum(1)))
    return np.array(bits), np.array(along), np.array(left), np.array(length)


class Anchors:
    """Rotated anchors in planes of bits, with what their rounding leaves."""

    def __init__(self, turned: np.ndarray, planes: int = PLANES):
        n, width = turned.shape
        self.low = turned.min(1) if n else np.zeros(0)
        self.step = np.maximum((turned.max(1) - self.low if n else self.low) / (2**planes - 1), 1e-300)
        units = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, 2**planes - 1).astype(np.int64)
        rounded = self.low[:, None] + self.step[:, None] * units
        self.total = rounded.sum(1)
        self.length = np.sqrt((turned * turned).sum(1))
        self.off = np.sqrt(((turned - rounded) ** 2).sum(1))
        self.planes = [np.packbits((units >> j & 1).astype(bool), axis=1, bitorder="little").view("<u8") for j in range(planes)]

    def along(self, i: np.ndarray | slice, bits: np.ndarray, dense: bool) -> np.ndarray:
        """Inner products of rounded anchors and codes (words, n) by popcounts: of all pairs, or of i[k] and k."""
        shape = (lambda x: x[i][:, None]) if dense else (lambda x: x[i])
        ones = np.zeros(bits.shape[1], np.int64)
        sums: np.ndarray | int = 0
        for w in range(len(bits)):
            ones += np.bitwise_count(bits[w])
            for j, plane in enumerate(self.planes):
                sums = sums + (np.bitwise_count(shape(plane[:, w]) & bits[w]).astype(np.int32) << j)
        return 2 * (shape(self.low) * ones + shape(self.step) * sums) - shape(self.total)


def best(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each anchor: higher scores first, then smaller ids, then smaller rows."""
    order = np.lexsort((row, ids, -score, anchor))
    a = anchor[order]
    head = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(head, np.diff(np.append(head, len(a))))
    return order[rank < k]


class Cell:
    """Anchors and rows of one group, and the k best rows in each of an anchor's bands."""

    def __init__(self, q: np.ndarray, turned: np.ndarray, q_row: np.ndarray, q_label: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        """low, high: the bands' ends (anchors, bands), in whole numbers; same: whether a row must share the label, or must not."""
        self.q, self.q_row, self.q_label, self.low, self.high, self.same, self.k = q, q_row, q_label, low, high, same, k
        self.planes = Anchors(turned)
        self.bar = low.copy()
        none = np.zeros(0, np.int64)
        self.held = [(none, none, none, none) for _ in range(low.shape[1])]  # anchor, score, id, row
        self.pairs = self.scored = 0

    def meet(self, v: np.ndarray, row: np.ndarray, ids: np.ndarray, label: np.ndarray, index: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> None:
        for r in range(0, len(v), ROWS):
            part = slice(r, r + ROWS)
            some = tuple(x[..., part] for x in index)
            for a in range(0, len(self.q), ANCHORS):
                self._block(slice(a, a + ANCHORS), v[part], row[part], ids[part], label[part], some)

    def _block(self, a: slice, v: np.ndarray, row: np.ndarray, ids: np.ndarray, label: np.ndarray, index: tuple) -> None:
        bits, along, left, length = index
        keep = ((self.q_label[a][:, None] == label) == self.same) & (self.q_row[a][:, None] != row)
        self.pairs += int(keep.sum())
        least, most = self.bar[a].min(1), self.high[a].max(1)
        guess = np.zeros(keep.shape)
        norm, off = self.planes.length[a], self.planes.off[a]
        level = 0
        while level < len(bits):
            guess += along[level] * self.planes.along(a, bits[level], True)
            width = norm[:, None] * (left[level] + ROOM * (length[level] + left[level])) + off[:, None] * length[level]
            keep &= (guess + width >= least[:, None]) & (guess - width <= most[:, None])
            level += 1
            if np.count_nonzero(keep) < keep.size // 8:
                break
        i, j = np.nonzero(keep)
        guess = guess[i, j]
        for more in range(level, len(bits)):  # few are left: one by one
            guess = guess + along[more][j] * self.planes.along(i + a.start, bits[more][:, j], False)
            width = norm[i] * (left[more][j] + ROOM * (length[more][j] + left[more][j])) + off[i] * length[more][j]
            stay = (guess + width >= least[i]) & (guess - width <= most[i])
            i, j, guess = i[stay], j[stay], guess[stay]
        if not len(i):
            return
        if (self.bar[a] == self.low[a]).all() and len(i) > 4 * self.k * len(keep):
            # no bar yet: the best guesses first, so that the others have one to pass
            first = best(i, guess, ids[j], row[j], 2 * self.k)
            self._score(a, i[first], j[first], v, row, ids)
            rest = np.ones(len(i), bool)
            rest[first] = False
            reach = norm[i] * (left[-1][j] * (1 + ROOM) + ROOM * length[-1][j]) + off[i] * length[-1][j]
            rest &= guess + reach >= self.bar[a].min(1)[i]
            i, j = i[rest], j[rest]
        self._score(a, i, j, v, row, ids)

    def _score(self, a: slice, i: np.ndarray, j: np.ndarray, v: np.ndarray, row: np.ndarray, ids: np.ndarray) -> None:
        """Whole-number scores of pairs, and the best of each band with those held."""
        if not len(i):
            return
        self.scored += len(i)
        q = self.q[a]
        score = ((q @ v.T)[i, j] if len(i) > len(q) * len(v) // 16 else np.einsum("ij,ij->i", q[i], v[j])).astype(np.int64)
        at = i + a.start
        for b in range(self.low.shape[1]):
            fits = (score >= self.bar[at, b]) & (score <= self.high[at, b])
            if not fits.any():
                continue
            both = tuple(np.concatenate([x, y]) for x, y in zip(self.held[b], (at[fits], score[fits], ids[j[fits]], row[j[fits]]), strict=True))
            kept = best(*both, self.k)
            anchor, s = both[0][kept], both[1][kept]
            self.held[b] = tuple(x[kept] for x in both)
            head = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            size = np.diff(np.append(head, len(anchor)))
            full = head[size == self.k] + self.k - 1
            self.bar[anchor[full], b] = np.maximum(self.bar[anchor[full], b], s[full])

    def found(self) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
        yield from enumerate(self.held)


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column."""
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str, width: int) -> np.ndarray:
    """Rows of a binary column as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = next(ragged.slices(column, 1 << 40))[2] if len(column) else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind).reshape(-1, width)


def _index(rows: DataFrame, width: int, kind: str, turn, levels: int) -> DataFrame:
    """row, vec_id, label, anchor, v (packed whole numbers) and code (packed bits, alignments, lengths)."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(4)
            sizes = np.asarray(column.value_lengths()).astype(np.int64)
            v = np.zeros((len(sizes), width), np.int64)
            v[np.repeat(np.arange(len(sizes)), sizes), ragged.expand(np.zeros(len(sizes), np.int64), sizes)] = column.flatten().to_numpy(zero_copy_only=False)
            bits, *lengths = codes(v.astype(np.float64) @ turn.value, levels)
            code = np.concatenate([bits.reshape(-1, len(v)), *(x.view("<u8") for x in lengths)]).T
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], _packed(v.astype(kind)), _packed(code)], ["row", "vec_id", "label", "anchor", "v", "code"])

    return rows.select("row", "vec_id", "label", "anchor", "v").mapInArrow(indexed, "row long, vec_id long, label long, anchor boolean, v binary, code binary")


def _met(dealt: DataFrame, width: int, kind: str, turn, same: bool, k: int, levels: int, percent: int, exact: str) -> DataFrame:
    """The k best rows of each group's anchors and bands: anchor row, band's high end, row, id, score."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = turn.value.shape[1] // 64
        for table, heads, owns in grouped(batches, 2 * RUN):
            ends = [*heads[1:].tolist(), table.num_rows]
            for h, o, e in zip(heads.tolist(), owns.tolist(), ends, strict=True):
                if not o or e - h == o:
                    continue
                group = table.slice(h, e - h)
                v = _matrix(group["v"], kind, width).astype(exact)
                code = _matrix(group["code"].slice(o), "<u8", levels * (words + 3)).T
                stored = np.ascontiguousarray(code[levels * words :]).view(np.float64).reshape(3, levels, -1)
                index = (code[: levels * words].reshape(levels, words, -1), *stored)
                row, label = group["row"].to_numpy(), group["label"].to_numpy()
                ids = group["vec_id"].fill_null(_LAST).to_numpy()
                if same:
                    high = np.full((o, 1), np.iinfo(np.int64).max)
                    low = np.full((o, 1), np.iinfo(np.int64).min)
                else:
                    bars = group["bars"].slice(0, o).combine_chunks()
                    size = np.asarray(bars.value_lengths()).astype(np.int64)
                    # a band that is not there holds nothing
                    high = np.full((o, int(size.max())), -1, np.int64)
                    high[np.repeat(np.arange(o), size), ragged.expand(np.zeros(o, np.int64), size)] = bars.flatten().to_numpy()
                    low = high // 100 * percent + -(-(high % 100) * percent // 100)  # rounded up, in parts that do not overflow
                    low[high < 0] = np.iinfo(np.int64).max
                cell = Cell(v[:o], v[:o].astype(np.float64) @ turn.value, row[:o], label[:o], low, high, same, k)
                cell.meet(v[o:], row[o:], ids[o:], label[o:], index)
                for b, (a, score, one, other) in cell.found():
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(row[:o][a]), pa.array(cell.high[a, b]), pa.array(other), pa.array(one, mask=one == _LAST), pa.array(score)], ["anchor", "bar", "other", "other_id", "score"])

    return dealt.mapInArrow(met, "anchor long, bar long, other long, other_id long, score long")


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of each group with their rank; Spark limits groups before the shuffle too."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", positives: int = 5, negatives: int = 5, percent: int = 80, levels: int = LEVELS, tile: int = TILE, run: int = RUN) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    A component x counts as floor(256 x); a score is the inner product with an anchor, higher ones first, ties by smaller id.
    An anchor's positives are its first other rows of the same label; for each, the first rows of other labels whose score
    is at most the positive's and at least so many percent of it. Rows with a null label, a null vector or a null or non-finite
    component take no part. Short vectors count as followed by zeros. Rows that repeat an id are rows of their own; null ids come
    last among ties, and are anchors where the condition says so. Scores beyond 64 bits raise. Other columns are dropped. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    arrow_batches(spark, 4000)
    v = F.col(f"`{vector}`").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(f"`{label}`").isNotNull() & v.isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.transform(v, lambda x: F.floor(256 * x)).alias("v"))
    width, largest = rows.agg(F.max(F.size("v")), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not width or largest is None:
        return spark.createDataFrame([], schema)
    if width * largest * largest >= 2**63:
        raise ValueError("scores of these vectors do not fit in 64 bits")
    kind = "<i2" if largest < 2**15 else "<i8"
    exact = "float64" if width * largest * largest < 2**53 else "int64"
    turn = spark.sparkContext.broadcast(rotation(int(width)))
    index, _ = written(_index(rows, int(width), kind, turn, levels), "codes")
    shape = (int(width), kind, turn)

    near = deal(index.select(F.col("label").alias("bucket"), F.col("anchor").alias("own"), "row", "vec_id", "label", "v", "code"), "row", tile, run, index.select(F.col("label").alias("bucket"), F.col("anchor").alias("own")))
    chosen, _ = written(_first(_met(near, *shape, True, positives, levels, percent, exact), ["anchor"], positives).drop("bar"), "positives")
    bars = chosen.where("score >= 0").groupBy("anchor").agg(F.collect_set("score").alias("bars"))  # as many as positives at most
    owns = index.where("anchor").join(bars.withColumnRenamed("anchor", "row"), "row", "left").withColumn("anchor", F.col("bars").isNotNull())
    every = index.where("not anchor").withColumn("bars", F.lit(None).cast("array<long>")).unionByName(owns)
    every = every.select(F.lit(0).cast("long").alias("bucket"), F.col("anchor").alias("own"), "row", "vec_id", "label", "v", "code", "bars")
    far = _met(deal(every, "row", tile, run, every.select("bucket", "own")), *shape, False, negatives, levels, percent, exact)
    hard = _first(far, ["anchor", "bar"], negatives)
    pairs = chosen.select(F.col("anchor").alias("_anchor"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = index.where("anchor").select(F.col("row").alias("_row"), F.col("vec_id").alias("anchor_id"))
    out = hard.join(pairs, (F.col("anchor") == F.col("_anchor")) & (F.col("bar") == F.col("positive_score"))).join(named, F.col("anchor") == F.col("_row"))
    return out.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
