"""Boosted trees on all rows and, side by side, on all but each fold (MD10): MLlib's trees for squared errors from sums by cell.

Trees see bins alone, so rows of equal bins are one cell: of each fold its number of rows and the sum of y. Cells are
written as blocks of arrays, and a level of all models' trees is one pass over them, whose histograms hang on models, nodes,
inputs and bins alone. What a pass reads stops growing with the rows once all cells are filled.

Where inputs are few, sums by bins of every as many inputs as a tree has levels fit the driver. They hold the histograms of all
levels of a tree, so a tree of all models is one pass, which sums what the tree takes from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.operators.quantiles import exact_quantiles
from assaygrid.shared import remove, written

#: Distinct values of an input that are counted one by one; of more, so many exact quantiles stand for them.
LISTED, RANKS = 10_000, 1_024
#: Trees that are evaluated in every pass before their sums are written with the cells.
FRESH = 10
#: Sums by bins of several inputs that the driver may hold, of all models (16 MB), and bytes of them that tasks pass on in a pass.
SUMS, PASSED = 2_000_000, 1 << 28
#: Cells that a task sums at a time, as many as there are bins to sum them by and more.
JOINED = 200_000


@dataclass
class Tree:
    """A full tree of a depth: nodes level by level, what lies above the cut of a bin goes right; a node that is not split sends all left."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray  # by leaf

    def place(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Of columns (inputs, cells): the node of a level that each cell comes to, from 0."""
        at = np.zeros(bins.shape[1], np.uint8)
        for level in range(levels):
            right = np.zeros(len(at), bool)
            for i in range(1 << level):
                k = (1 << level) - 1 + i
                if self.bin[k] < 255:
                    right |= (at == i) & (bins[self.feature[k]] > self.bin[k])
            at = 2 * at + right
        return at

    def box(self, node: int, level: int) -> dict[int, tuple[int, int]]:
        """The bins (from, to) of each input that a node of a level is cut to."""
        out: dict[int, tuple[int, int]] = {}
        for above in range(level):
            k = (1 << above) - 1 + (node >> (level - above))
            right, f, b = node >> (level - above - 1) & 1, int(self.feature[k]), int(self.bin[k])
            low, high = out.get(f, (0, 256))
            out[f] = (max(low, b + 1), high) if right else (low, min(high, b + 1))
        return out

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.place(bins, len(self.value).bit_length() - 1)]


@dataclass
class Folded:
    n: int
    gains: np.ndarray  # by input, of the trees on all rows
    r_squared: float | None  # on all rows
    held: list[float]  # R2 on each fold of the trees on the others


def cuts_of(values: list[tuple[float, float]], most: int) -> list[float]:
    """MLlib's cuts between distinct values (value, number): all, or at most so many near equal shares of the rows."""
    v, n = (list(c) for c in zip(*sorted(values), strict=True)) if values else ([], [])
    middle = [a + (b - a) / 2 for a, b in zip(v, v[1:])]
    if len(middle) <= most:
        return middle
    stride = sum(n) / (most + 1)
    out, upto, target = [], n[0], stride
    for i in range(1, len(v)):
        before, upto = upto, upto + n[i]
        if abs(before - target) < abs(upto - target):
            out.append(middle[i - 1])
            target += stride
    return out


def all_cuts(rows: DataFrame, x: list[str], most: int) -> list[list[float]]:
    """Of each input its cuts, from the exact numbers of its values."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[float, int]] = [{} for _ in x]
        for batch in batches:
            for i, d in enumerate(held):
                if len(d) <= LISTED:  # beyond that it is known to have too many
                    for v, n in zip(*(a.tolist() for a in np.unique(batch.column(i).to_numpy(), return_counts=True)), strict=True):
                        d[v] = d.get(v, 0) + n
        at = np.repeat(np.arange(len(x), dtype=np.int32), [len(d) for d in held])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([v for d in held for v in d], pa.float64()), pa.array([n for d in held for n in d.values()], pa.int64())], ["c", "v", "n"])

    values, path = written(rows.select(*x).mapInArrow(counted, "c int, v double, n long").groupBy("c", "v").agg(F.sum("n").alias("n")), "values")
    sizes = {r["c"]: r["k"] for r in values.groupBy("c").agg(F.count("*").alias("k")).collect()}  # a row an input
    listed: dict[int, list[tuple[float, float]]] = {c: [] for c, k in sizes.items() if k <= LISTED}
    for r in values.where(F.col("c").isin(list(listed))).toLocalIterator():  # LISTED values an input at most
        listed[r["c"]].append((r["v"], r["n"]))
    remove(rows.sparkSession, path)
    many = [x[c] for c in sizes if c not in listed]
    ranks = exact_quantiles(rows, many, [(k + 0.5) / RANKS for k in range(RANKS)], linear=False) if many else {}
    for c in sizes:
        if c not in listed:
            v, n = np.unique(ranks[x[c]], return_counts=True)
            listed[c] = list(zip(v.tolist(), n.tolist(), strict=True))
    return [cuts_of(listed.get(c, []), most) for c in range(len(x))]


def _blocks(rows: DataFrame, x: list[str], cuts: list[list[float]], folds: int, centre: float) -> DataFrame:
    """Cells of (fold, y, x) as blocks: bins by input, numbers of rows and sums of y by fold, and the models' values, zero so far."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = np.column_stack([np.searchsorted(c, batch.column(2 + i).to_numpy(), side="left") for i, c in enumerate(cuts)]).astype(np.uint8)
            flat = pa.py_buffer(np.ascontiguousarray(b).tobytes())
            ends = pa.py_buffer(np.arange(0, b.size + 1, b.shape[1], dtype=np.int32).tobytes()) if b.size else pa.py_buffer(np.zeros(1, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.Array.from_buffers(pa.binary(), len(b), [None, ends, flat])], ["fold", "y", "b"])

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1).T
                n, s = (np.stack([batch.column(1 + k * folds + i).to_numpy() for i in range(folds)]).astype(float) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), *[pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (bins, n, s, np.zeros((folds + 1, batch.num_rows)))]], ["cells", "b", "n", "s", "f"])

    mine = [F.col("fold") == i for i in range(folds)]
    cells = rows.select("fold", (F.col("y") - F.lit(centre)).alias("y"), *x).mapInArrow(binned, "fold int, y double, b binary").groupBy("b")
    return cells.agg(*[F.count_if(m).alias(f"n{i}") for i, m in enumerate(mine)], *[F.coalesce(F.sum(F.when(m, F.col("y"))), F.lit(0.0)).alias(f"s{i}") for i, m in enumerate(mine)]).mapInArrow(blocked, "cells long, b binary, n binary, s binary, f binary")


def _read(batch: pa.RecordBatch, fresh: list[list[Tree]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each block: bins, numbers and sums by fold, and values of every model, fresh trees included."""
    for cells, *parts in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
        bins, n, s, f = (np.frombuffer(p, t).reshape(-1, cells) for p, t in zip(parts, (np.uint8, float, float, float), strict=True))
        if fresh:
            f = f + np.stack([sum(t[i].values(bins) for t in fresh) for i in range(len(f))])
        yield bins, n, s, f


def _models(a: np.ndarray) -> Iterator[np.ndarray]:
    """Of an array by fold what each model learns from: all folds, then all but each."""
    total = a.sum(0)
    yield total
    for held in a:
        yield total - held


def _histograms(data: DataFrame, width: int, size: int, fresh: list[list[Tree]], trees: list[Tree], level: int) -> np.ndarray:
    """(2, models, nodes, inputs, bins): sums of residuals and numbers of rows by node of a level."""
    nodes = 1 << level
    shape = (2, len(trees), nodes, width, size)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for bins, n, s, f in _read(batch, fresh):
                wide = bins.astype(np.intp)
                for i, (count, y) in enumerate(zip(_models(n), _models(s), strict=True)):
                    start, residual = trees[i].place(bins, level).astype(np.intp) * size, y - count * f[i]
                    for c in range(width):
                        key = start + wide[c]
                        total[0, i, :, c] += np.bincount(key, residual, nodes * size).reshape(nodes, size)
                        total[1, i, :, c] += np.bincount(key, count, nodes * size).reshape(nodes, size)
        flat = total.reshape(2, -1)
        at = np.flatnonzero(flat[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[0][at]), pa.array(flat[1][at])], ["at", "g", "n"])

    out = np.zeros((2, int(np.prod(shape[1:]))))
    # so many numbers as there are models, nodes, inputs and bins
    for r in data.mapInArrow(summed, "at long, g double, n double").groupBy("at").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toArrow().to_batches():
        at = r.column(0).to_numpy()
        out[0][at], out[1][at] = r.column(1).to_numpy(), r.column(2).to_numpy()
    return out.reshape(shape)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Bins and further columns of some JOINED cells at a time."""
    held, cells = [], 0
    for batch in batches:
        for n, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append([np.frombuffer(p, float if i else np.uint8).reshape(-1, n) for i, p in enumerate(parts)])
            cells += n
            if cells >= JOINED:
                yield tuple(np.concatenate(a, axis=1) for a in zip(*held, strict=True))
                held, cells = [], 0
    if held:
        yield tuple(np.concatenate(a, axis=1) for a in zip(*held, strict=True))


class Cubes:
    """Of every model: numbers of rows and sums of residuals by bins of each choice of so many inputs, on the driver."""

    def __init__(self, data: DataFrame, sizes: list[int], ways: int, folds: int):
        self.sizes, self.choices = sizes, list(combinations(range(len(sizes)), ways))
        bytes_ = 8 * (folds + 1) * self.numbers(sizes, ways)
        self.data = data.coalesce(max(1, min(data.sparkSession.sparkContext.defaultParallelism, PASSED // bytes_)))
        first = self._summed(["n", "s"], lambda bins, n, s: [*n, *s], 2 * folds)
        self.n, self.g = ([np.stack(list(_models(a[k * folds : (k + 1) * folds]))) for a in first] for k in (0, 1))

    @staticmethod
    def numbers(sizes: list[int], ways: int) -> int:
        return sum(int(np.prod([sizes[c] for c in choice])) for choice in combinations(range(len(sizes)), ways))

    def _summed(self, columns: list[str], weights, width: int) -> list[np.ndarray]:
        """Of each choice (width, bins ...): sums over cells of what weights gives of their bins and columns by fold."""
        sizes, choices = self.sizes, self.choices
        shapes = [tuple(sizes[c] for c in choice) for choice in choices]

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((width, int(np.prod(shape)))) for shape in shapes]
            for bins, *sums in _joined(batches):
                given, wide = weights(bins, *sums), bins.astype(np.intp)
                for t, choice in zip(total, choices, strict=True):
                    key = wide[choice[0]]
                    for c in choice[1:]:
                        key = key * sizes[c] + wide[c]
                    for i, w in enumerate(given):
                        t[i] += np.bincount(key, w, t.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()], pa.binary()) for t in total], [f"t{k}" for k in range(len(total))])

        out = [np.zeros((width, *shape)) for shape in shapes]
        # PASSED bytes at most, in as many rows as there are tasks
        for batch in self.data.select("cells", "b", *columns).mapInArrow(summed, ", ".join(f"t{k} binary" for k in range(len(shapes)))).toArrow().to_batches():
            for k, o in enumerate(out):
                for t in batch.column(k):
                    o += np.frombuffer(t.as_buffer(), float).reshape(o.shape)
        return out

    def histograms(self, trees: list[Tree], level: int) -> np.ndarray:
        """(2, models, nodes, inputs, bins), as _histograms gives them."""
        out = np.zeros((2, len(trees), 1 << level, len(self.sizes), max(self.sizes)))
        for i, tree in enumerate(trees):
            for node in range(1 << level):
                box = tree.box(node, level)
                for c, size in enumerate(self.sizes):
                    k = next(k for k, choice in enumerate(self.choices) if {*box, c} <= {*choice})
                    at = tuple(slice(*box[f]) if f in box else slice(None) for f in self.choices[k])
                    others = tuple(a for a, f in enumerate(self.choices[k]) if f != c)
                    here = slice(*box[c]) if c in box else slice(0, size)
                    for o, held in zip(out, (self.g, self.n), strict=True):
                        o[i, node, c, :size][here] = held[k][i][at].sum(others)
        return out

    def move(self, trees: list[Tree]) -> None:
        """Takes what trees give from the residuals."""
        taken = self._summed(["n"], lambda bins, n: [count * tree.values(bins) for count, tree in zip(_models(n), trees, strict=True)], len(trees))
        for g, t in zip(self.g, taken, strict=True):
            g -= t


def _advanced(data: DataFrame, fresh: list[list[Tree]]) -> DataFrame:
    """data with what fresh trees give added to the models' values."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [f.tobytes() for *_, f in _read(batch, fresh)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(f, pa.binary())], batch.schema.names)

    return data.mapInArrow(added, data.schema)


def _errors(data: DataFrame, folds: int, fresh: list[list[Tree]]) -> dict[int, float]:
    """Of each model what its values take from the squares of y: on all rows for the first, else on its fold."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(folds + 1)
        for batch in batches:
            for _, n, s, f in _read(batch, fresh):
                total += [(n.sum(0) * f[0] ** 2 - 2 * f[0] * s.sum(0)).sum(), *((n * f[1:] - 2 * s) * f[1:]).sum(1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(folds + 1, dtype=np.int32)), pa.array(total)], ["m", "e"])

    return {r["m"]: r["e"] for r in data.mapInArrow(summed, "m int, e double").groupBy("m").agg(F.sum("e").alias("e")).collect()}  # a row a model


def boost_folds(rows: DataFrame, x: list[str], folds: int, rounds: int = 200, depth: int = 3, step: float = 0.05, bins: int = 32) -> Folded | None:
    """Boosted trees for squared errors on all rows (fold int, y, x doubles without nulls) and on all but each fold; None without rows.

    As MLlib grows them: bins between values, the first tree whole, then steps of twice the residual (its gradient); children of one
    row at least. Bins are cut once, from all rows. rows are read four times or more, so they should be a written table.
    """
    whole = rows.agg(F.count("*").alias("n"), F.avg("y").alias("m"), (F.var_pop("y") * F.count("*")).alias("sst")).first()
    if not whole["n"]:
        return None
    centre = float(whole["m"])
    d = F.col("y") - F.lit(centre)
    of = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum(d * d).alias("yy"), (F.var_pop("y") * F.count("*")).alias("sst")).collect()}  # a row a fold
    cuts = all_cuts(rows, x, max(min(bins, whole["n"]) - 1, 1))
    used = [i for i, c in enumerate(cuts) if c]
    gains = np.zeros(len(x))
    if not used:
        x, used, cuts = x[:1], [0], [[]]
    data, path = written(_blocks(rows, [x[i] for i in used], [cuts[i] for i in used], folds, centre), "cells")
    size = max(len(c) for c in cuts) + 1
    sizes, ways = [len(cuts[i]) + 1 for i in used], min(depth, len(used))
    cubes = Cubes(data, sizes, ways, folds) if ways and Cubes.numbers(sizes, ways) * (folds + 1) <= SUMS else None
    fresh: list[list[Tree]] = []
    for number in range(rounds):
        weight = 2 * step if number else 1.0
        trees = [Tree(np.zeros((1 << depth) - 1, int), np.full((1 << depth) - 1, 255), np.zeros(1 << depth)) for _ in range(folds + 1)]
        for level in range(depth):
            g, n = cubes.histograms(trees, level) if cubes else _histograms(data, len(used), size, fresh, trees, level)
            left_g, left_n = np.cumsum(g, -1)[..., :-1], np.cumsum(n, -1)[..., :-1]
            total_g, total_n = g[:, :, :1].sum(-1, keepdims=True), n[:, :, :1].sum(-1, keepdims=True)
            worth = lambda a, b: a * a / np.maximum(b, 1)
            gain = np.where((left_n > 0) & (left_n < total_n), worth(left_g, left_n) + worth(total_g - left_g, total_n - left_n) - worth(total_g, total_n), 0.0)
            scaled = np.round(gain / max(whole["sst"], 1e-300), 14)
            for i, tree in enumerate(trees):
                for node in range(1 << level):
                    f, b = divmod(int(np.argmax(scaled[i, node])), size - 1) if size > 1 else (0, 0)
                    split = size > 1 and scaled[i, node, f, b] > 0
                    total = total_g[i, node, 0, 0], total_n[i, node, 0, 0]
                    if split:
                        tree.feature[(1 << level) - 1 + node], tree.bin[(1 << level) - 1 + node] = f, b
                        gains[used[f]] += gain[i, node, f, b] * (4 if number else 1) if not i else 0.0
                    parts = [(left_g[i, node, f, b], left_n[i, node, f, b]), (total[0] - left_g[i, node, f, b], total[1] - left_n[i, node, f, b])] if split else [total, (0.0, 0.0)]
                    # the last level's are the leaves; those above it are written over
                    span = 1 << (depth - level - 1)
                    for side, (a, k) in enumerate(parts):
                        tree.value[(2 * node + side) * span : (2 * node + side + 1) * span] = weight * a / k if k else 0.0
        fresh.append(trees)
        if cubes and number < rounds - 1:
            cubes.move(trees)
        elif not cubes and len(fresh) == FRESH and number < rounds - 1:
            before = path
            data, path = written(_advanced(data, fresh), "cells")
            remove(rows.sparkSession, before)
            fresh = []
    found = _errors(data, folds, fresh)
    remove(rows.sparkSession, path)
    yy = sum(r["yy"] for r in of.values())
    held = [1 - (r["yy"] + found[i + 1]) / r["sst"] for i, r in sorted(of.items()) if r["sst"] and r["n"] < whole["n"]]
    return Folded(whole["n"], gains, 1 - (yy + found[0]) / whole["sst"] if whole["sst"] else None, held)
