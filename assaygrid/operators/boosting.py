"""Boosted trees that take missing values as they are (MD11, FL13): quantile bins, histograms summed over executors.

Inputs become bin numbers once, in a written table of one byte an input. A level of a tree is one pass: tasks sum gradients and
counts by node, input and bin, and what is collected is these sums, whose number hangs on nodes, inputs and bins alone. A
split sends missing values to the side where they gain more. Trees are added to the rows' values in memory, and the table is written anew
every FRESH trees, so that a pass evaluates few. Where rows share their bins with many others, what is written every FRESH trees
is sums by cell of equal bins, for the sample of each of these trees, and passes read these cells instead of rows. Cells that are
few, however many rows they stand for, are collected, and these trees grow without a pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.operators.quantiles import exact_quantiles
from assaygrid.shared import remove, written

#: Bins of an input; bin MISSING holds what has no value.
BINS, MISSING = 255, 255
#: Trees that are evaluated in every pass before their sums are written to the table.
FRESH = 20
#: Rows that a cell of equal bins must hold on average for passes over cells.
SHARED = 8
#: Rows that a smaller table counts as, so that its cells are held whether rows share them or not.
FEW = 400_000
#: Cells of equal bins that the driver may hold, each with the sums of FRESH trees' samples (16 MB).
HELD = 50_000


@dataclass
class Split:
    feature: int
    bin: int  # rows of this bin or a lower one go left
    threshold: float  # so do values below this
    missing_left: bool
    gain: float
    left: int = -1
    right: int = -1


@dataclass
class Tree:
    """Nodes by number: a Split, or a leaf's value."""

    nodes: dict[int, Split | float] = field(default_factory=dict)

    def place(self, bins: np.ndarray, stop: int | None = None) -> np.ndarray:
        """The node that each row (of bin numbers) comes to."""
        at = np.zeros(len(bins), np.int64)
        for number in sorted(self.nodes):
            node = self.nodes[number]
            if isinstance(node, Split):
                here = np.flatnonzero(at == number)
                b = bins[here, node.feature]
                left = np.where(b == MISSING, node.missing_left, b <= node.bin)
                at[here] = np.where(left, node.left, node.right)
        return at

    def values(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(max(self.nodes) + 1)
        for k, node in self.nodes.items():
            out[k] = 0.0 if isinstance(node, Split) else node
        return out[at]


@dataclass
class Boosted:
    x: list[str]
    base: float
    cuts: list[list[float]]
    trees: list[Tree]
    n: int
    r_squared: float
    adj_r_squared: float

    def importances(self) -> dict[str, float]:
        """Each input's mean gain a split, as a share of all inputs' means."""
        gains: dict[int, list[float]] = {}
        for t in self.trees:
            for s in t.nodes.values():
                if isinstance(s, Split):
                    gains.setdefault(s.feature, []).append(s.gain)
        means = {i: float(np.mean(g)) for i, g in gains.items()}
        total = sum(means.values())
        return {c: means.get(i, 0.0) / total if total else 0.0 for i, c in enumerate(self.x)}

    def significant(self) -> list[str]:
        """The third of the inputs, one at least, of the greatest importance."""
        share = self.importances()
        return sorted(share, key=lambda c: (-share[c], self.x.index(c)))[: max(1, len(self.x) // 3)]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """df with name: what the trees give; missing inputs go their default ways."""
        given = df.select("*", *[_input(c).alias(f"_x{i}") for i, c in enumerate(self.x)])
        model, first = self, len(df.columns)

        def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = binned([batch.column(first + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(model.x))], model.cuts)
                out = np.full(batch.num_rows, model.base)
                for t in model.trees:
                    out += t.values(t.place(bins))
                yield pa.RecordBatch.from_arrays([*batch.columns[:first], pa.array(out)], [*batch.schema.names[:first], name])

        return given.mapInArrow(predicted, df.select("*", F.lit(0.0).alias(name)).schema)


def _input(column: str):
    x = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(x), x)


def binned(columns: list[np.ndarray], cuts: list[list[float]]) -> np.ndarray:
    """Bin numbers: how many cuts a value reaches; MISSING for NaN."""
    return np.column_stack([np.where(np.isnan(v), MISSING, np.searchsorted(c, v, side="right")) for v, c in zip(columns, cuts, strict=True)]).astype(np.uint8)


def soft(g, alpha: float):
    """A sum of gradients less the L1 penalty, not beyond zero."""
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def best_split(g: np.ndarray, h: np.ndarray, features: list[int], cuts: list[list[float]], l1: float, l2: float, least: float) -> Split | None:
    """Of histograms (features, BINS + 1) of a node: the split of the greatest gain; of equal ones the first input, lowest bin, and missing values left."""
    total_g, total_h = g[features[0]].sum(), h[features[0]].sum()
    worth = lambda a, b: soft(a, l1) ** 2 / np.maximum(b + l2, 1e-300)
    found: Split | None = None
    for f in features:
        k = len(cuts[f])
        if not k:
            continue
        left_g, left_h = np.cumsum(g[f, :k]), np.cumsum(h[f, :k])
        gains = []
        for side in (1, 0):  # missing values left, then right
            a, b = left_g + side * g[f, MISSING], left_h + side * h[f, MISSING]
            gain = 0.5 * (worth(a, b) + worth(total_g - a, total_h - b) - worth(total_g, total_h))
            gains.append(np.where((b >= least) & (total_h - b >= least), gain, -np.inf))
        both = np.stack(gains, 1)  # bins, sides
        at = int(np.argmax(np.round(both.ravel(), 9)))
        gain = float(both.ravel()[at])
        if gain > 1e-9 and (found is None or round(gain, 9) > round(found.gain, 9)):
            found = Split(f, at // 2, cuts[f][at // 2], at % 2 == 0, gain)
    return found


def _in_sample(mark: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Whether rows are in a tree's sample, by their mark alone."""
    if share >= 1:
        return np.ones(len(mark), bool)
    u = (mark.view(np.uint64) ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
    u ^= u >> np.uint64(32)
    u *= np.uint64(0xD6E8FEB86659FD93)
    return (u >> np.uint64(11)) < np.uint64(int(share * 2**53))


def boost(df: DataFrame, y: str, x: list[str], rounds: int = 300, depth: int = 3, step: float = 0.05, rows: float = 0.8, columns: float = 0.8, least: float = 3.0, l1: float = 0.1, l2: float = 1.0, seed: int = 42, bins: int = BINS) -> Boosted | None:
    """Trees for squared errors on all rows that have y, whatever inputs they lack; None if there are fewer than 10.

    rows: the share of rows that a tree sees, chosen by a hash of the row; columns: the share of inputs; least: rows of a child at
    least; l1, l2: penalties on leaves. A pass over the rows for each level of each tree.
    """
    spark = df.sparkSession
    bins = min(bins, BINS)
    plain = df.select(_input(y).alias("y"), *[_input(c).alias(f"x{i}") for i, c in enumerate(x)]).where("y is not null")
    plain, given = written(plain, "rows")  # read in some eight passes
    seen = plain.agg(F.count("*").alias("n"), F.avg("y").alias("m"), (F.var_pop("y") * F.count("*")).alias("sst")).first()
    n = seen["n"]
    if n < 10:
        remove(spark, given)
        return None
    found = exact_quantiles(plain, [f"x{i}" for i in range(len(x))], [k / bins for k in range(1, bins)], linear=False)
    low = plain.agg(*[F.min(f"x{i}").alias(f"x{i}") for i in range(len(x))]).first()
    # a cut at the least value parts nothing
    cuts = [sorted({v for v in found[f"x{i}"] if v is not None and v > low[f"x{i}"]}) for i in range(len(x))]
    base = float(seen["m"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = binned([batch.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(x))], cuts)
            target = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(target), pa.array(np.full(len(target), base)), pa.array([r.tobytes() for r in b], pa.binary())], ["mark", "y", "f", "b"])

    marked = plain.select(F.xxhash64("y", *[f"x{i}" for i in range(len(x))]).alias("mark"), "y", *[f"x{i}" for i in range(len(x))])
    schema = "mark long, y double, f double, b binary"
    data, path = written(marked.mapInArrow(made, schema), "bins")
    remove(spark, given)
    cells = data.select("b").distinct().count()
    by_cell = cells * SHARED <= max(n, FEW)
    every, at = data, path
    held: Held | None = None
    rng = np.random.default_rng(seed)
    trees: list[Tree] = []
    fresh: list[Tree] = []  # not yet in f
    for number in range(rounds):
        chosen = sorted(rng.choice(len(x), max(1, round(columns * len(x))), replace=False).tolist())
        tree = Tree({0: 0.0})
        open_ = [0]
        if by_cell and number % FRESH == 0:
            if number and not held:
                remove(spark, path)
            data = _cells(every, len(x), base, trees, range(number, min(number + FRESH, rounds)), rows)
            if cells <= HELD:
                held = Held(data.toArrow(), len(x))  # HELD rows at most
            else:
                data, path = written(data, "cells")
            fresh = []
        for level in range(depth):
            sums = _histograms(held or data, len(x), chosen, fresh, tree, open_, number, None if by_cell else rows)
            following = []
            for node in open_:
                g, h = sums[node]
                split = best_split(g, h, chosen, cuts, l1, l2, least)
                tree.nodes[node] = float(-step * soft(g[chosen[0]].sum(), l1) / (h[chosen[0]].sum() + l2))
                if split:
                    split.left, split.right = max(tree.nodes) + 1, max(tree.nodes) + 2
                    k = split.bin + 1
                    left_g = g[split.feature, :k].sum() + (g[split.feature, MISSING] if split.missing_left else 0.0)
                    left_h = h[split.feature, :k].sum() + (h[split.feature, MISSING] if split.missing_left else 0.0)
                    for child, (a, b) in ((split.left, (left_g, left_h)), (split.right, (g[split.feature].sum() - left_g, h[split.feature].sum() - left_h))):
                        tree.nodes[child] = float(-step * soft(a, l1) / (b + l2))
                        following.append(child)
                    tree.nodes[node] = split
            open_ = following
            if not open_:
                break
        trees.append(tree)
        fresh.append(tree)
        if held:
            held.f += tree.values(tree.place(held.bins))
        if not by_cell and len(fresh) == FRESH and number < rounds - 1:
            data, before = _advanced(data, len(x), fresh, schema), path
            data, path = written(data, "bins")
            remove(spark, before)
            fresh = []
    if by_cell:
        if not held:
            remove(spark, path)
        path, d = at, F.col("f") - F.lit(base)
        whole = _cells(every, len(x), base, trees, range(1), 1.0)  # of all rows
        sse = (seen["sst"] or 0.0) + whole.agg(F.sum(d * (F.col("n0") * d - 2 * (F.col("s0") - F.col("n0") * F.lit(base)))).alias("s")).first()["s"]
    else:
        sse = _advanced(data, len(x), fresh, schema).agg(F.sum((F.col("y") - F.col("f")) ** 2).alias("s")).first()["s"]
    remove(spark, path)
    r2 = 1 - sse / seen["sst"] if seen["sst"] else 0.0
    p = len(x)
    return Boosted(list(x), base, cuts, trees, n, float(r2), float(1 - (1 - r2) * (n - 1) / (n - p - 1)) if n > p + 1 else float(r2))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)


def _where(tree: Tree, nodes: list[int]) -> np.ndarray:
    """Of each node of a tree its place in nodes, or -1."""
    where = np.full(max(tree.nodes) + 1, -1)
    where[nodes] = np.arange(len(nodes))
    return where


def _add(total: np.ndarray, bins: np.ndarray, grad: np.ndarray, count: np.ndarray, place: np.ndarray, features: list[int]) -> None:
    """Adds gradients and counts to total (2, nodes, inputs, bins); place: the node of each row, -1 for none."""
    some, nodes, size = place >= 0, total.shape[1], total.shape[3]
    for f in features:
        key = place[some] * size + bins[some, f]
        total[0, :, f] += np.bincount(key, grad[some], nodes * size).reshape(nodes, size)
        total[1, :, f] += np.bincount(key, count[some], nodes * size).reshape(nodes, size)


class Held:
    """Cells of equal bins with their values and the sums of some trees' samples, on the driver."""

    def __init__(self, cells: pa.Table, width: int):
        self.cells = cells
        self.bins = _matrix(cells.column("b").combine_chunks(), width) if cells.num_rows else np.zeros((0, width), np.uint8)
        self.f = cells.column("f").to_numpy().copy()

    def count(self) -> int:
        return len(self.f)

    def histograms(self, features: list[int], tree: Tree, nodes: list[int], number: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        count = self.cells.column(f"n{number}").to_numpy().astype(float)
        grad = count * self.f - self.cells.column(f"s{number}").to_numpy()
        total = np.zeros((2, len(nodes), self.bins.shape[1], BINS + 1))
        _add(total, self.bins, grad, count, _where(tree, nodes)[tree.place(self.bins)], features)
        return {node: (total[0, i], total[1, i]) for i, node in enumerate(nodes)}


def _histograms(data: DataFrame | Held, width: int, features: list[int], fresh: list[Tree], tree: Tree, nodes: list[int], number: int, share: float | None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums of gradients and counts by node, input and bin over the rows of a tree's sample; share None: data are cells."""
    if isinstance(data, Held):
        return data.histograms(features, tree, nodes, number)
    n, y = f"n{number}", f"s{number}"
    data = data.select(n, y, "f", "b") if share is None else data

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(nodes), width, BINS + 1))
        where = _where(tree, nodes)
        for batch in batches:
            mark = batch.column(0).to_numpy()
            ok = mark > 0 if share is None else _in_sample(mark, number, share)
            if not ok.any():
                continue
            bins = _matrix(batch.column(3), width)[ok]
            count = mark[ok].astype(float) if share is None else np.ones(len(bins))
            grad = count * batch.column(2).to_numpy()[ok] - batch.column(1).to_numpy()[ok]
            for t in fresh:
                grad = grad + count * t.values(t.place(bins))
            _add(total, bins, grad, count, where[tree.place(bins)], features)
        at = np.flatnonzero(total[1].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0].ravel()[at]), pa.array(total[1].ravel()[at])], ["at", "g", "h"])

    out = np.zeros((2, len(nodes) * width * (BINS + 1)))
    # so many numbers as there are nodes, inputs and bins
    for r in data.mapInArrow(summed, "at long, g double, h double").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow().to_batches():
        at = r.column(0).to_numpy()
        out[0][at], out[1][at] = r.column(1).to_numpy(), r.column(2).to_numpy()
    g, h = out.reshape(2, len(nodes), width, BINS + 1)
    return {node: (g[i], h[i]) for i, node in enumerate(nodes)}


def _cells(data: DataFrame, width: int, base: float, trees: list[Tree], numbers: range, share: float) -> DataFrame:
    """Of each cell of equal bins b: its value f by the trees so far, and of each numbered tree's sample the rows and the sum of y."""
    names = [f"{c}{t}" for t in numbers for c in ("n", "s")]
    schema = "b binary, " + ", ".join(f"{c} {'long' if c[0] == 'n' else 'double'}" for c in names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            code, k, mark, y = coded.indices.to_numpy(), len(coded.dictionary), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = []
            for t in numbers:
                ok = _in_sample(mark, t, share)
                out += [pa.array(np.bincount(code[ok], minlength=k)), pa.array(np.bincount(code[ok], y[ok], k))]
            yield pa.RecordBatch.from_arrays([coded.dictionary, *out], ["b", *names])

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _matrix(batch.column(0), width)
            f = np.full(len(bins), base)
            for t in trees:
                f += t.values(t.place(bins))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(f)], [*batch.schema.names, "f"])

    return data.select("mark", "y", "b").mapInArrow(summed, schema).groupBy("b").agg(*[F.sum(c).alias(c) for c in names]).mapInArrow(valued, schema + ", f double")


def _advanced(data: DataFrame, width: int, fresh: list[Tree], schema: str) -> DataFrame:
    """data with what fresh trees give added to f."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, f = _matrix(batch.column(3), width), batch.column(2).to_numpy().copy()
            for t in fresh:
                f += t.values(t.place(bins))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f), batch.column(3)], ["mark", "y", "f", "b"])

    return data.mapInArrow(added, schema)
