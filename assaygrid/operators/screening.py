"""The screening engine (SE, MD, DG): many small regressions from shared sufficient statistics.

One pass groups rows by the pattern of what they lack and sums the products of all variables (a Gram
matrix a pattern); each candidate's matrix is the sum over patterns that have all it needs. Fits then
need no data: coefficients, errors, p-values, information criteria, variance inflation, condition. A
second pass, over survivors alone, gives what hangs on residuals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.functions.stats import chi2_sf, f_sf, t_quantile, t_sf2
from assaygrid.operators.order import in_blocks, numbered
from assaygrid.shared import remove, written

SIZES = (1, 2, 3, 4)
CAP, MIN_R2, MAX_CORRELATION, TOP = 36, 0.06, 0.95, 12
MIN_LITERATURE = 0.30
QUOTAS = {"time_only": 2, "time_plus_parameter": 5, "parameter_only": 5}


@dataclass(frozen=True)
class Candidate:
    y: str
    x: tuple[str, ...]
    index: int


def candidates(pool: list[str], outcomes: list[str], sizes: tuple[int, ...] = SIZES, cap: int = CAP, time: str | None = None) -> list[Candidate]:
    """SE1, SE4, DD7: of each size the first cap subsets in pool order, then those with time and one to three more; no subset twice."""
    plain = [c for c in pool if c != time]
    subsets = [s for k in sizes for s in islice(combinations(plain, k), cap)]
    if time in pool:
        subsets += [(time,)] + [(time, *s) for k in (1, 2, 3) for s in islice(combinations(plain, k), cap)]
    subsets = list(dict.fromkeys(subsets))
    return [Candidate(y, s, i) for y in outcomes for i, s in enumerate(s for s in subsets if y not in s)]


@dataclass
class Gram:
    """Sums by (group, pattern of present variables); variables are shifted and scaled."""

    variables: list[str]
    shift: np.ndarray
    scale: np.ndarray
    sums: dict[tuple, dict[int, np.ndarray]]  # group -> mask -> (1, v)(1, v)'


def gram(df: DataFrame, variables: list[str], by: list[str] | None = None) -> Gram:
    """§4.3: one aggregate for centre and spread, one pass of Arrow partial sums and one shuffle of them."""
    by = by or []
    d = [F.col(f"`{v}`").cast("double") for v in variables]
    clean = df.select(*[F.col(f"`{b}`").cast("string").alias(f"_g{i}") for i, b in enumerate(by)], *[F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x).alias(f"_v{i}") for i, x in enumerate(d)])
    r = clean.agg(*[F.avg(f"_v{i}").alias(f"m{i}") for i in range(len(variables))], *[F.stddev_pop(f"_v{i}").alias(f"s{i}") for i in range(len(variables))]).first()
    shift = np.array([r[f"m{i}"] or 0.0 for i in range(len(variables))])
    scale = np.array([r[f"s{i}"] or 1.0 for i in range(len(variables))])
    n, groups = len(variables) + 1, len(by)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            v = np.column_stack([batch.column(groups + i).to_numpy(zero_copy_only=False).astype(float) for i in range(n - 1)])
            have = ~np.isnan(v)
            if not len(v):
                continue
            z = np.column_stack([np.ones(len(v)), np.where(have, (v - shift) / scale, 0.0)])
            mask = np.packbits(have, axis=1, bitorder="little")
            coded = [batch.column(i).cast(pa.string()).dictionary_encode() for i in range(groups)]
            code = np.column_stack([mask, *[c.indices.fill_null(-1).to_numpy() for c in coded]]).astype(np.int64)
            patterns, which = np.unique(code, axis=0, return_inverse=True)
            which = which.ravel()
            for i, found in enumerate(patterns):
                values = (c.dictionary[j].as_py() if j >= 0 else None for c, j in zip(coded, found[mask.shape[1] :].tolist(), strict=True))
                k = (*values, found[: mask.shape[1]].astype(np.uint8).tobytes())
                part = z[which == i]
                total[k] = total.get(k, 0) + part.T @ part
        rows = list(total.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([list(map(str, k[:-1])) if groups else [] for k, _ in rows], pa.list_(pa.string())), pa.array([k[-1] for k, _ in rows], pa.binary()), pa.array([m.ravel() for _, m in rows], pa.list_(pa.float64()))],
            ["g", "mask", "m"],
        )

    parts = clean.mapInArrow(summed, "g array<string>, mask binary, m array<double>")
    cells = parts.select("g", "mask", F.posexplode("m").alias("at", "x")).groupBy("g", "mask", "at").agg(F.sum("x").alias("x"))
    sums: dict[tuple, dict[int, np.ndarray]] = {}
    for r in cells.groupBy("g", "mask").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("m")).toLocalIterator():  # (k + 1)^2 numbers a pattern
        sums.setdefault(tuple(r["g"]), {})[int.from_bytes(r["mask"], "little")] = np.array([c["x"] for c in r["m"]]).reshape(n, n)
    return Gram(variables, shift, scale, sums)


def complete(g: Gram, names: list[str], group: tuple = ()) -> np.ndarray:
    """The matrix of (1, names) over rows that have all names, in original units."""
    at = [g.variables.index(v) for v in names]
    need = sum(1 << i for i in at)
    n = len(g.variables) + 1
    total = sum((m for mask, m in g.sums.get(group, {}).items() if mask & need == need), np.zeros((n, n)))
    pick = [0, *[i + 1 for i in at]]
    return total[np.ix_(pick, pick)]


@dataclass
class Fit:
    y: str
    x: tuple[str, ...]
    n: int
    coefficients: dict[str, float]
    errors: dict[str, float]
    p_values: dict[str, float]
    r_squared: float
    adj_r_squared: float
    f: float
    f_p: float
    aic: float
    bic: float
    max_vif: float
    condition: float
    sse: float
    rank: int
    inverse: np.ndarray  # of X'X in original units, intercept first


def solve(g: Gram, y: str, x: tuple[str, ...], group: tuple = (), ridge: float = 0.0, least: int = 8, more: int = 3) -> Fit | None:
    """FL3, MD1, MD2, SE7: least squares on complete rows (the least-norm fit if singular); None if there are fewer than least rows, or than inputs and so many more.

    ridge: a penalty on coefficients but the intercept; p-values are then 0.5 and adjusted R2 is R2.
    """
    m = complete(g, [*x, y], group)
    n, k = int(round(m[0, 0])), len(x)
    if n < max(least, k + more):
        return None
    s = np.array([g.scale[g.variables.index(v)] for v in (*x, y)])
    shift = np.array([g.shift[g.variables.index(v)] for v in (*x, y)])
    mean = m[0, 1:] / n
    c = m[1:, 1:] - n * np.outer(mean, mean)  # centred, scaled
    sxx, sxy, syy = c[:k, :k], c[:k, k], c[k, k]
    if syy <= 1e-12 * max(n, 1):
        return None if not ridge else Fit(y, x, n, {}, {}, {}, 0.0, 0.0, 0.0, 1.0, math.nan, math.nan, 1.0, math.nan, 0.0, 0, np.zeros((k + 1, k + 1)))
    penalty = np.diag([ridge / s[i] ** 2 for i in range(k)]) if ridge else 0.0
    values, axes = np.linalg.eigh(sxx + penalty)
    good = values > 1e-10 * max(values.max(), 1e-300)
    inv = (axes[:, good] / values[good]) @ axes[:, good].T
    b = inv @ sxy
    sse = max(float(syy - 2 * b @ sxy + b @ sxx @ b), 0.0)
    rank = int(good.sum())
    df = n - rank - 1
    r2 = float(1 - sse / syy)
    beta = b * s[k] / s[:k]
    centre = shift[:k] + mean[:k] * s[:k]
    intercept = shift[k] + mean[k] * s[k] - float(beta @ centre)
    inv_units = inv / np.outer(s[:k], s[:k])
    inverse = np.zeros((k + 1, k + 1))
    inverse[1:, 1:] = inv_units
    inverse[0, 1:] = inverse[1:, 0] = -inv_units @ centre
    inverse[0, 0] = 1 / n + centre @ inv_units @ centre
    sse_units = float(sse * s[k] ** 2)
    sigma2 = sse_units / df if df > 0 else math.nan
    se = np.sqrt(np.maximum(np.diag(inverse) * sigma2, 0))
    names = ["const", *x]
    coef = np.append(intercept, beta)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = [0.5] * (k + 1) if ridge else [t_sf2(float(t), df) for t in np.where(se > 0, coef / se, np.inf)]
    f = (r2 / rank) / ((1 - r2) / df) if rank and df > 0 and r2 < 1 else math.inf
    ll = -n / 2 * (math.log(2 * math.pi * max(sse_units, 1e-300) / n) + 1)
    d = np.sqrt(np.maximum(np.diag(sxx), 1e-300))
    vif = float(np.diag(np.linalg.pinv(sxx / np.outer(d, d))).max()) if k > 1 else 1.0
    raw = np.zeros((k + 1, k + 1))
    raw[0, 0] = n
    raw[0, 1:] = raw[1:, 0] = n * centre
    raw[1:, 1:] = sxx * np.outer(s[:k], s[:k]) + n * np.outer(centre, centre)
    eig = np.linalg.eigvalsh(raw)
    condition = float(math.sqrt(eig[-1] / eig[0])) if eig[0] > 0 else math.inf
    adj = r2 if ridge else 1 - (1 - r2) * (n - 1) / df if df > 0 else r2
    return Fit(y, x, n, dict(zip(names, coef.tolist(), strict=True)), dict(zip(names, se.tolist(), strict=True)), dict(zip(names, p, strict=True)), r2, adj, f, f_sf(f, rank, df), -2 * ll + 2 * (rank + 1), -2 * ll + math.log(n) * (rank + 1), vif, condition, sse_units, rank, inverse)


def correlated(g: Gram, x: tuple[str, ...], group: tuple = (), most: float = MAX_CORRELATION) -> bool:
    """FL4: whether two of x correlate at most or more, over rows that have both."""
    for a, b in combinations(x, 2):
        m = complete(g, [a, b], group)
        n = m[0, 0]
        if n < 3:
            continue
        c = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / n
        if c[0, 0] > 0 and c[1, 1] > 0 and abs(c[0, 1]) / math.sqrt(c[0, 0] * c[1, 1]) >= most:
            return True
    return False


def confidence(fit: Fit) -> dict[str, tuple[float, float]]:
    """95 % intervals of a fit's coefficients."""
    q = t_quantile(0.975, fit.n - fit.rank - 1)
    return {k: (b - q * fit.errors[k], b + q * fit.errors[k]) for k, b in fit.coefficients.items()}


@dataclass
class Residuals:
    """What is known of the residuals e of a run of rows in their order; runs that follow each other are put together by then()."""

    n: int
    mean: np.ndarray  # of e, e * e, fitted values and y
    cross: np.ndarray  # sums of products about those means
    cubes: float
    fourths: float
    steps: float  # squared differences from row to row
    absolute: float
    relative: float  # |e / y| where y is not zero
    zeros: int
    cook: float
    n_cook: int
    first: float
    last: float

    @classmethod
    def of(cls, y: np.ndarray, fitted: np.ndarray, cook: np.ndarray, limit: float) -> Residuals:
        e = y - fitted
        e2, step, there = e * e, np.diff(e), y != 0
        w = np.stack([e, e2, fitted, y])
        mean = w.mean(1)
        w -= mean[:, None]
        share = np.divide(e, y, out=np.zeros(len(e)), where=there)
        return cls(len(e), mean, w @ w.T, float(e2 @ e), float(e2 @ e2), float(step @ step), float(np.abs(e).sum()), float(np.abs(share).sum()), int(len(y) - there.sum()), float(cook.max()), int((cook > limit).sum()), float(e[0]), float(e[-1]))

    def then(self, o: Residuals) -> Residuals:
        n, d = self.n + o.n, o.mean - self.mean
        cross = self.cross + o.cross + np.outer(d, d) * self.n * o.n / n
        steps = self.steps + o.steps + (o.first - self.last) ** 2
        return Residuals(n, self.mean + d * o.n / n, cross, self.cubes + o.cubes, self.fourths + o.fourths, steps, self.absolute + o.absolute, self.relative + o.relative, self.zeros + o.zeros, max(self.cook, o.cook), self.n_cook + o.n_cook, self.first, o.last)

    def flat(self) -> list[float]:
        return [self.n, *self.mean, *self.cross.ravel(), self.cubes, self.fourths, self.steps, self.absolute, self.relative, self.zeros, self.cook, self.n_cook, self.first, self.last]

    @classmethod
    def back(cls, v) -> Residuals:
        v = list(v)
        return cls(int(v[0]), np.array(v[1:5], float), np.array(v[5:21], float).reshape(4, 4), *map(float, v[21:26]), int(v[26]), float(v[27]), int(v[28]), *map(float, v[29:]))

    def summary(self) -> dict:
        n, m = self.n, float(self.mean[0])
        squares = float(self.cross[0, 0]) + n * m * m
        var = float(self.cross[0, 0]) / n
        third = self.cubes / n - 3 * m * squares / n + 2 * m**3
        fourth = self.fourths / n - 4 * m * self.cubes / n + 6 * m * m * squares / n - 3 * m**4
        bp = float(self.cross[1, 2] ** 2 / (self.cross[1, 1] * self.cross[2, 2])) if self.cross[1, 1] > 0 and self.cross[2, 2] > 0 else None
        return {
            "durbin_watson": self.steps / squares if squares > 0 else None,
            "skew": third / var**1.5 if var > 0 else None,
            "kurt": fourth / var**2 - 3 if var > 0 else None,
            "bp_lite_r2": bp,
            "rmse": math.sqrt(squares / n),
            "mae": self.absolute / n,
            "mape": 100 * self.relative / n if not self.zeros else None,
            "y_std": math.sqrt(self.cross[3, 3] / (n - 1)) if n > 1 else None,
            "max_cooks_d": self.cook,
            "n_influential": self.n_cook,
            "n": n,
        }


def _regime(regime: str | None):
    """The regime of a row as text, as gram() groups it."""
    return F.coalesce(F.col(f"`{regime}`").cast("string"), F.lit("None")) if regime else F.lit("")


def _members(column: pa.Array, groups: list[str]) -> dict[str, np.ndarray]:
    """The rows of a batch that belong to each group."""
    found = column.cast(pa.string()).dictionary_encode()
    code = found.indices.to_numpy(zero_copy_only=False)
    names = {v: i for i, v in enumerate(found.dictionary.to_pylist())}
    return {g: code == names[g] if g in names else np.zeros(len(code), bool) for g in set(groups)}


def residual_tests(df: DataFrame, fits: list[Fit], row_id: str, regime: str | None = None, groups: list[str] | None = None) -> list[dict]:
    """DG2-DG5, DG8, DG17, DG19: of each fit, from one pass over rows in the order of row_id (null ones first).

    Rows are sorted by ranges of row_id, in the order of its type; a task passes on one summary a fit, and these are put together in order.
    groups: the regime (a column's value as text) that each fit is of; all regimes share the pass.
    """
    if not fits:
        return []
    variables = sorted({v for f in fits for v in (*f.x, f.y)})
    shared = [(f.y, f.x, np.array([f.coefficients[k] for k in ("const", *f.x)]), f.inverse, f.sse / max(f.n - f.rank - 1, 1), f.n) for f in fits]
    of = groups or [""] * len(fits)
    rows = df.select(F.col(f"`{row_id}`").alias("_row"), _regime(regime).alias("_g"), *[F.col(f"`{v}`").cast("double").alias(f"_v{i}") for i, v in enumerate(variables)])
    ordered = rows.repartitionByRange(F.col("_row").asc_nulls_first()).sortWithinPartitions(F.col("_row").asc_nulls_first()).drop("_row").withColumn("_part", F.spark_partition_id())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, Residuals]] = {}
        for batch in batches:
            data = {v: batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i, v in enumerate(variables)}
            row = batch.column(len(variables) + 1).to_numpy()
            finite = {v: np.isfinite(d) for v, d in data.items()}
            members = _members(batch.column(0), of)
            for c, (y, x, b, inverse, s2, n) in enumerate(shared):
                ok = np.logical_and.reduce([members[of[c]], finite[y], *[finite[v] for v in x]])
                if not ok.any():
                    continue
                z, t = np.stack([np.ones(len(row)), *[data[v] for v in x]]), data[y]
                if not ok.all():
                    z, t = z[:, ok], t[ok]
                fitted = b @ z
                h = np.einsum("ij,ij->j", z, inverse @ z)
                cook = (t - fitted) ** 2 / (len(z) * max(s2, 1e-300)) * h / np.maximum(1 - h, 1e-12) ** 2
                found = Residuals.of(t, fitted, cook, 4 / n)
                total[c] = (total[c][0], total[c][1].then(found)) if c in total else (int(row[ok][0]), found)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([r for r, _ in total.values()], pa.int64()), pa.array([s.flat() for _, s in total.values()], pa.list_(pa.float64()))], ["fit", "row", "s"])

    def joined(pdf):
        import pandas as pd

        runs = [Residuals.back(s) for s in pdf.sort_values("row", kind="stable")["s"]]
        return pd.DataFrame({"fit": [pdf["fit"].iloc[0]], "s": [reduce(Residuals.then, runs).flat()]})

    found = ordered.mapInArrow(pieces, "fit int, row long, s array<double>").groupBy("fit").applyInPandas(joined, "fit int, s array<double>")
    out = []
    for r in sorted(found.collect(), key=lambda r: r["fit"]):  # a row a fit
        d = Residuals.back(r["s"]).summary()
        jb = d["n"] / 6 * (d["skew"] ** 2 + d["kurt"] ** 2 / 4) if d["skew"] is not None else None
        d |= {"fit": r["fit"], "y_col": fits[r["fit"]].y, "x_cols": list(fits[r["fit"]].x), "jarque_bera": jb, "jarque_bera_p": math.exp(-jb / 2) if jb is not None else None}
        d["bp_lite_p"] = chi2_sf(d["n"] * d["bp_lite_r2"], 1) if d["bp_lite_r2"] is not None else None
        out.append(d)
    return out


def auxiliary_tests(df: DataFrame, fit: Fit) -> dict:
    """DG2, DG5: Koenker's Breusch-Pagan and RESET of power two of a fit, each by a Gram pass over its residuals or squares."""
    fitted = F.lit(fit.coefficients["const"])
    for v in fit.x:
        fitted = fitted + F.col(f"`{v}`").cast("double") * F.lit(fit.coefficients[v])
    rows = df.select(*[F.col(f"`{v}`").cast("double").alias(v) for v in (*fit.x, fit.y)]).na.drop().withColumn("_fitted", fitted)
    rows = rows.withColumn("_e2", (F.col(fit.y) - F.col("_fitted")) ** 2).withColumn("_f2", F.col("_fitted") ** 2)
    g = gram(rows, [*fit.x, fit.y, "_e2", "_f2"])
    bp, reset = solve(g, "_e2", fit.x), solve(g, fit.y, (*fit.x, "_f2"))
    out = {"breusch_pagan": bp.n * bp.r_squared if bp else None, "breusch_pagan_p": chi2_sf(bp.n * bp.r_squared, len(fit.x)) if bp else None, "reset": None, "reset_p": None}
    if reset and reset.rank > fit.rank and reset.sse > 0:
        d2 = reset.n - reset.rank - 1
        out["reset"] = max(fit.sse - reset.sse, 0) / (reset.sse / d2)
        out["reset_p"] = f_sf(out["reset"], 1, d2)
    return out


def auxiliary_batch(df: DataFrame, fits: list[Fit], g: Gram, regime: str | None = None, groups: list[str] | None = None) -> list[dict]:
    """auxiliary_tests of many fits (of regimes: groups) from one pass: a Gram matrix of 1, x, residual, its square and the squared fit for each."""
    if not fits:
        return []
    variables = sorted({v for f in fits for v in (*f.x, f.y)})
    of = {v: (g.shift[g.variables.index(v)], g.scale[g.variables.index(v)]) for v in variables}
    shared = [(f.y, f.x, np.array([f.coefficients[k] for k in ("const", *f.x)]), math.sqrt(f.sse / f.n) or 1.0) for f in fits]
    regimes = groups or [""] * len(fits)
    rows = df.select(_regime(regime).alias("_g"), *[F.col(f"`{v}`").cast("double").alias(f"_v{i}") for i, v in enumerate(variables)])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(x) + 4, len(x) + 4)) for _, x, _, _ in shared]
        for batch in batches:
            data = {v: batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i, v in enumerate(variables)}
            finite = {v: np.isfinite(d) for v, d in data.items()}
            scaled = {v: (d - of[v][0]) / of[v][1] for v, d in data.items()}
            members = _members(batch.column(0), regimes)
            for m, (y, x, b, s), group in zip(total, shared, regimes, strict=True):
                ok = np.logical_and.reduce([members[group], *[finite[v] for v in (*x, y)]])
                every = ok.all()
                pick = lambda a: a if every else a[ok]  # noqa: B023, E731  used at once
                fitted = b[0] + b[1:] @ np.stack([pick(data[v]) for v in x])
                e = (pick(data[y]) - fitted) / s
                # a shift of the fit changes nothing: x spans what it adds
                w = np.stack([np.ones(len(e)), *[pick(scaled[v]) for v in x], e, e * e, ((fitted - of[y][0]) / of[y][1]) ** 2])
                m += w @ w.T
        flat = [m.ravel() for m in total]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(flat), dtype=np.int32), [len(m) for m in flat])), pa.array(np.concatenate([np.arange(len(m), dtype=np.int32) for m in flat])), pa.array(np.concatenate(flat))], ["fit", "at", "v"])

    sums = [np.zeros((len(f.x) + 4) ** 2) for f in fits]
    for r in rows.mapInArrow(summed, "fit int, at int, v double").groupBy("fit", "at").agg(F.sum("v").alias("v")).toLocalIterator():  # (k + 4)^2 numbers a fit
        sums[r["fit"]][r["at"]] = r["v"]

    def least(m: np.ndarray, x: list[int], y: int) -> tuple[int, float, float]:
        """Rank, squared errors and squares about the mean of a fit with an intercept."""
        c = m - np.outer(m[0], m[0]) / m[0, 0]
        sxx, sxy = c[np.ix_(x, x)], c[x, y]
        values, axes = np.linalg.eigh(sxx)
        good = values > 1e-10 * max(values.max(), 1e-300)
        along = axes[:, good].T @ sxy
        return int(good.sum()), max(float(c[y, y] - (along**2 / values[good]).sum()), 0.0), float(c[y, y])

    out = []
    for f, v in zip(fits, sums, strict=True):
        k = len(f.x)
        m, x = v.reshape(k + 4, k + 4), list(range(1, k + 1))
        n, e, e2, f2 = m[0, 0], k + 1, k + 2, k + 3
        _, sse, sst = least(m, x, e2)
        bp = n * (1 - sse / sst) if sst > 1e-12 * n else None
        d = {"breusch_pagan": None if bp is None else float(bp), "breusch_pagan_p": chi2_sf(bp, k) if bp is not None else None, "reset": None, "reset_p": None}
        rank, sse, sst = least(m, [*x, f2], e)
        d2 = n - rank - 1
        if rank > f.rank and sse > 0 and d2 > 0:
            d["reset"] = float(max(sst - sse, 0.0) / (sse / d2))
            d["reset_p"] = f_sf(d["reset"], 1, d2)
        out.append(d)
    return out


def composite(bp: float | None, dw: float | None, vif: float | None, jb: float | None, reset: float | None) -> float:
    """DG9: the weight of passed tests among those there are; 0.5 without any."""
    checks = ((bp, lambda v: v > 0.05, 0.28), (dw, lambda v: 1.5 < v < 2.5, 0.22), (vif, lambda v: v < 5, 0.22), (jb, lambda v: v > 0.05, 0.15), (reset, lambda v: v > 0.05, 0.13))
    there = [(ok(v), w) for v, ok, w in checks if v is not None]
    total = sum(w for _, w in there)
    return round(sum(w for ok, w in there if ok) / total, 4) if total else 0.5


def panel_composite(adf: float | None, icc: float | None, within_r2: float | None, f_p: float | None, entities: int | None) -> float:
    """DG13."""
    parts = [(0.35, adf), (0.20, None if icc is None else min(1.0, icc / 0.5)), (0.25, None if within_r2 is None else min(1.0, within_r2 / 0.5)), (0.15, None if f_p is None else float(f_p < 0.05)), (0.05, None if entities is None else min(1.0, entities / 10))]
    total = sum(w for w, v in parts if v is not None)
    return round(sum(w * v for w, v in parts if v is not None) / total, 4) if total else 0.5


def effective(ols: float | None, panel: float | None) -> float:
    """SE9."""
    return 0.5 if ols is None else ols if panel is None else round(math.sqrt(ols * panel), 4)


def model_class(x: tuple[str, ...] | list[str], time: str | None) -> str:
    """SE8."""
    return "parameter_only" if time is None or time not in x else "time_only" if len(x) == 1 else "time_plus_parameter"


def quota_rank(rows: list[dict], time: str | None, top: int = TOP) -> list[dict]:
    """TK3: rows (y_col, x_cols, score) by bucket quotas in order, no (y, x) twice, filled to top by score."""
    ordered = sorted(enumerate(rows), key=lambda p: (-p[1]["score"], p[0]))
    chosen: list[dict] = []
    seen: set = set()

    def take(row: dict) -> None:
        key = (row["y_col"], tuple(row["x_cols"]))
        if key not in seen and len(chosen) < top:
            seen.add(key)
            chosen.append(row)

    for bucket, quota in QUOTAS.items():
        for row in [r for _, r in ordered if model_class(r["x_cols"], time) == bucket][:quota]:
            take(row)
    for _, row in ordered:
        take(row)
    return chosen


@dataclass
class Screened:
    """A candidate with its scores; fit is None for a fixed effects fit, which has its own."""

    group: str
    y: str
    x: list[str]
    fit: Fit | None
    panel_fit: object | None
    ols_score: float
    panel_score: float | None

    @property
    def r_squared(self) -> float:
        return self.fit.r_squared if self.fit else self.panel_fit.overall_r2

    @property
    def adjusted(self) -> float:
        return self.fit.adj_r_squared if self.fit else self.panel_fit.within_r2

    @property
    def diagnostic(self) -> float:
        return effective(self.ols_score, self.panel_score)

    @property
    def score(self) -> float:
        return (self.fit.r_squared if self.fit else self.panel_fit.within_r2) * self.diagnostic

    @property
    def model_type(self) -> str:
        return "screening_linear" if self.fit else "panel_fixed_effects"

    @property
    def n(self) -> int:
        return (self.fit or self.panel_fit).n

    def maps(self) -> tuple[dict[str, float], dict[str, float]]:
        found = self.fit or self.panel_fit
        rounded = lambda d: {k: round(v, 6) for k, v in d.items() if k != "const" and math.isfinite(v)}
        return rounded(found.coefficients), rounded(found.p_values)


def _scored(df: DataFrame, fits: list[Fit], groups: list[str], g: Gram, row_id: str, regime: str | None, parts: dict, with_residuals: bool = True) -> list[Screened]:
    """Fits with their diagnostics: two passes over the rows for all regimes."""
    of = groups if regime else None
    tests = residual_tests(df, fits, row_id, regime, of) if with_residuals else [None] * len(fits)
    more = auxiliary_batch(df, fits, g, regime, of) if with_residuals else [None] * len(fits)
    out = []
    for f, group, t, a in zip(fits, groups, tests, more, strict=True):
        ols = composite(a["breusch_pagan_p"], t["durbin_watson"], f.max_vif, t["jarque_bera_p"], a["reset_p"]) if t else 0.5
        part = parts.get(group)
        within = [v for v in f.x if part and v in part.within]
        panel = panel_composite(part.adf_fraction(within), part.icc.get(f.y), None, None, None) if within else None
        out.append(Screened(group, f.y, list(f.x), f, None, ols, panel))
    return out


def _panel_fits(df: DataFrame, inputs: list[str], outcomes: list[str], groups: list[str], entity: str, time: str, regime: str | None, parts: dict) -> list[Screened]:
    """A fixed effects fit for each regime and outcome: time and all inputs that vary within entities."""
    from assaygrid.operators import within

    names = lambda group: list(dict.fromkeys([*([] if time in parts[group].within else [time]), *[c for c in inputs if c in parts[group].within]]))
    specs = [(group, y, names(group)) for group in groups if group in parts for y in outcomes if y not in names(group)]
    if not specs:
        return []
    moments = within.entity_moments(df, list(dict.fromkeys([time, *inputs, *outcomes])), entity, regime)
    out = []
    for i, fit in within.within_fits(moments, specs, always=(time,)).items():
        group, y, x = specs[i]
        part = parts[group]
        tested = list(dict.fromkeys([time, *fit.x]))
        score = panel_composite(part.adf_fraction(tested), part.icc.get(y), fit.within_r2, round(fit.f_p, 6), fit.n_entities)
        out.append(Screened(group, y, x, None, fit, score, None))
    return out


def screen(df: DataFrame, inputs: list[str], outcomes: list[str], row_id: str, time: str | None = None, regime: str | None = None, with_residuals: bool = True, top: int = TOP, entity: str | None = None, order: list[str] | None = None) -> DataFrame:
    """SE4: the best models of each regime: regime, rank, y_col, x_cols, model_class, model_type, n, r_squared, adj_r_squared, max_vif, coefficients, p_values, diagnostic_score, panel_score, score.

    FL5, FL7: regimes of 12 or more rows, fits of R2 0.06 or more. One Gram pass for all candidates of all regimes;
    with_residuals adds two passes for the composites of all survivors. With entity and time there is the panel half: a score of
    the columns that vary within entities (SE9 joins the two), and a fixed effects fit for each outcome, which is
    ranked by what it explains within. order: what orders an entity's rows (default: time and row_id).
    """
    from assaygrid.operators import within

    spark = df.sparkSession
    variables = list(dict.fromkeys([*inputs, *([time] if time else []), *outcomes]))
    g = gram(df, variables, [regime] if regime else [])
    groups = [k for k in sorted(g.sums, key=str) if sum(m[0, 0] for m in g.sums[k].values()) >= 12]
    fits, of = [], []
    for group in groups:
        for c in candidates([*inputs, *([time] if time else [])], outcomes, time=time):
            if not correlated(g, tuple(v for v in c.x if v != time), group) and (f := solve(g, c.y, c.x, group)) and f.r_squared >= MIN_R2:
                fits.append(f)
                of.append(group[0] if group else "all")
    names = [k[0] if k else "all" for k in groups]
    panel = bool(entity and time)
    parts = within.panel_parts(df, inputs, outcomes, entity, order or [time, row_id], regime, (time,)) if panel else {}
    found = _scored(df, fits, of, g, row_id, regime, parts, with_residuals)
    effects = _panel_fits(df, inputs, outcomes, names, entity, time, regime, parts) if panel else []
    out = []
    for name in names:
        first = sorted((c for c in effects if c.group == name), key=lambda c: -c.adjusted)
        rest = [c for c in found if c.group == name]
        rows = [{"y_col": c.y, "x_cols": c.x, "score": c.score, "c": c} for c in [*first, *(sorted(rest, key=lambda c: -c.score) if panel else rest)]]
        for rank, r in enumerate(quota_rank(rows, time, top), 1):
            c = r["c"]
            vif = round(c.fit.max_vif, 4) if c.fit else None
            out.append((name, rank, c.y, c.x, model_class(c.x, time), c.model_type, c.n, round(c.r_squared, 4), round(c.adjusted, 4), vif, *c.maps(), c.diagnostic, c.panel_score if c.fit else c.ols_score, round(c.score, 6)))
    return spark.createDataFrame(out, "regime string, rank int, y_col string, x_cols array<string>, model_class string, model_type string, n long, r_squared double, adj_r_squared double, max_vif double, coefficients map<string,double>, p_values map<string,double>, diagnostic_score double, panel_score double, score double")


def kfold_r2(df: DataFrame, y: str, x: tuple[str, ...], row_id: str, folds: int = 5) -> list[float]:
    """DG18: R2 on each contiguous block of rows (by row_id) of a fit on the others: total less fold Grams, one pass."""
    rows = df.select(F.col(row_id).alias("_r"), *[F.col(f"`{v}`").cast("double").alias(v) for v in (*x, y)]).na.drop()
    n = rows.count()
    folds = min(folds, n // 5)
    if folds < 2:
        return []
    # contiguous blocks, the first n % folds of one row more
    size, longer = divmod(n, folds)
    at = F.col("_n")
    first = longer * (size + 1)
    ranked = numbered(rows, ["_r"], "_n").withColumn("fold", F.when(at < first, F.floor(at / (size + 1))).otherwise(longer + F.floor((at - first) / size)))
    g = gram(ranked, [*x, y], ["fold"])
    out = []
    for held in sorted(g.sums):
        rest = Gram(g.variables, g.shift, g.scale, {(): {}})
        for group, masks in g.sums.items():
            if group != held:
                for mask, m in masks.items():
                    rest.sums[()][mask] = rest.sums[()].get(mask, 0) + m
        fit = solve(rest, y, x)
        if fit is None:
            continue
        m = complete(g, [*x, y], held)
        s = np.array([g.scale[g.variables.index(v)] for v in (*x, y)])
        shift = np.array([g.shift[g.variables.index(v)] for v in (*x, y)])
        t = np.zeros((len(s) + 1, len(s) + 1))
        t[0, 0], t[1:, 0], t[1:, 1:] = 1, shift, np.diag(s)
        raw = t @ m @ t.T
        w = np.array([-fit.coefficients["const"], *[-fit.coefficients[v] for v in x], 1.0])
        sst = raw[-1, -1] - raw[0, -1] ** 2 / raw[0, 0]
        out.append(float(1 - (w @ raw @ w) / sst) if sst > 0 else math.nan)
    return out


def influence(df: DataFrame, fit: Fit) -> dict:
    """DG19: n_influential (Cook's distance above 4 / n), n_high_leverage (hat value above 2 k / n), max_studentized (residuals, each by the others' deviation)."""
    names = ["const", *fit.x]
    rows = df.select(*[F.col(f"`{v}`").cast("double").alias(v) for v in (*fit.x, fit.y)]).na.drop().withColumn("const", F.lit(1.0))
    hat, fitted = F.lit(0.0), F.lit(0.0)
    for i, a in enumerate(names):
        fitted = fitted + F.lit(fit.coefficients[a]) * F.col(f"`{a}`")
        for j, b in enumerate(names):
            hat = hat + F.lit(float(fit.inverse[i, j])) * F.col(f"`{a}`") * F.col(f"`{b}`")
    p = fit.rank + 1
    s2 = fit.sse / max(fit.n - p, 1)
    e, h = F.col("_e"), F.col("_h")
    cook = e**2 / (p * max(s2, 1e-300)) * h / F.greatest(1 - h, F.lit(1e-12)) ** 2
    others = ((fit.n - p) * s2 - e**2 / F.greatest(1 - h, F.lit(1e-12))) / max(fit.n - p - 1, 1)
    studentized = F.abs(e) / F.sqrt(F.greatest(others * (1 - h), F.lit(1e-300)))
    r = rows.withColumn("_h", hat).withColumn("_e", F.col(f"`{fit.y}`") - fitted).agg(F.count_if(cook > 4 / fit.n).alias("c"), F.count_if(h > 2 * len(fit.x) / fit.n).alias("h"), F.max(studentized).alias("s")).first()
    return {"n_influential": r["c"], "n_high_leverage": r["h"], "max_studentized": r["s"]}


def serial_correlation(df: DataFrame, fit: Fit, row_id: str, block: int = 100_000) -> float | None:
    """DG20: the p-value of Breusch and Godfrey's test with two lags."""
    found = breusch_godfrey(df, fit, row_id, block)
    return found[1] if found else None


def breusch_godfrey(df: DataFrame, fit: Fit, row_id: str, block: int = 100_000) -> tuple[float, float] | None:
    """DG20: statistic and p-value with two lags, in the order of row_id; before the first row residuals count as 0."""
    rows = df.select(F.col(row_id).alias("_r"), *[F.col(f"`{v}`").cast("double").alias(f"x{i}") for i, v in enumerate(fit.x)], F.col(f"`{fit.y}`").cast("double").alias("_y")).na.drop()
    fitted = F.lit(fit.coefficients["const"])
    for i, v in enumerate(fit.x):
        fitted = fitted + F.lit(fit.coefficients[v]) * F.col(f"x{i}")
    scale = math.sqrt(fit.sse / fit.n) or 1.0
    placed = in_blocks(numbered(rows.withColumn("e", (F.col("_y") - fitted) / scale), ["_r"], "t"), "t", block, 2)
    names = [f"x{i}" for i in range(len(fit.x))]
    lagged = placed.groupBy("b").applyInPandas(lambda key, pdf: _two_lags(pdf, key[0] * block, names), ", ".join(f"{n} double" for n in [*names, "before", "two", "e"]))
    g = gram(lagged, [*names, "before", "two", "e"])
    full = solve(g, "e", (*names, "before", "two"))
    return (full.n * full.r_squared, chi2_sf(full.n * full.r_squared, 2)) if full else None


def _two_lags(pdf, start: int, names: list[str]):
    """Rows of a block from place start on, with the residuals of the two rows before."""
    pdf = pdf.sort_values("t")
    e = pdf["e"].to_numpy()
    out = pdf[names].copy()
    out["before"], out["two"], out["e"] = np.append(0.0, e[:-1])[: len(e)], np.append([0.0, 0.0], e)[: len(e)], e
    return out[pdf["t"].to_numpy() >= start]


def heteroscedasticity(df: DataFrame, fit: Fit) -> float | None:
    """DG20: the p-value of White's test."""
    found = white(df, fit)
    return found[1] if found else None


def white(df: DataFrame, fit: Fit) -> tuple[float, float] | None:
    """DG20: White's statistic and p-value: squared residuals on inputs, their squares and products."""
    rows = df.select(*[F.col(f"`{v}`").cast("double").alias(f"x{i}") for i, v in enumerate(fit.x)], F.col(f"`{fit.y}`").cast("double").alias("_y")).na.drop()
    fitted = F.lit(fit.coefficients["const"])
    for i, v in enumerate(fit.x):
        fitted = fitted + F.lit(fit.coefficients[v]) * F.col(f"x{i}")
    k = len(fit.x)
    m = rows.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(k)], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(k)]).first()
    z = [(F.col(f"x{i}") - F.lit(m[f"m{i}"])) / F.lit(m[f"s{i}"] or 1.0) for i in range(k)]  # spans the same products
    parts = [*[z[i].alias(f"z{i}") for i in range(k)], *[(z[i] * z[j]).alias(f"z{i}_{j}") for i in range(k) for j in range(i, k)]]
    wide = rows.select(*parts, (((F.col("_y") - fitted) ** 2) / (fit.sse / fit.n or 1.0)).alias("e2"))
    names = tuple(c for c in wide.columns if c != "e2")
    full = solve(gram(wide, [*names, "e2"]), "e2", names)
    return (full.n * full.r_squared, chi2_sf(full.n * full.r_squared, full.rank)) if full else None


def standardized(g: Gram, fit: Fit) -> dict[str, float]:
    """DG21: coefficients in deviations: b sd(x) / sd(y) over the fit's rows."""
    m = complete(g, [*fit.x, fit.y])
    n = m[0, 0]
    sd = np.sqrt(np.maximum(np.diag(m)[1:] / n - (m[0, 1:] / n) ** 2, 0)) * np.array([g.scale[g.variables.index(v)] for v in (*fit.x, fit.y)])
    return {v: float(fit.coefficients[v] * (sd[i] or 1.0) / max(sd[-1], 1e-9)) for i, v in enumerate(fit.x)}


#: DG10: what a ridge fit scores, whatever its residuals.
RIDGE_SCORE = 0.40


def fit_count(g: Gram, pool: list[str], outcomes: list[str], panel: bool = False, sizes: tuple[int, ...] = (2, 3, 5), least: int = 8) -> int:
    """SE2: how many fits a screening makes: six a subset with enough complete rows, and one more where there is a panel design."""
    total = 0
    for c in candidates(pool, outcomes, sizes=sizes):
        if not correlated(g, c.x) and complete(g, [*c.x, c.y])[0, 0] >= max(least, len(c.x) + 3):
            total += 6 + panel
    return total


def panel_design(df: DataFrame, x: list[str], y: str, entity: str, time: str, row_id: str, least: int = 10) -> DataFrame | None:
    """SE3: complete rows of x, time and a code of the entity by first appearance, with y; None if there are fewer than least."""
    rows = df.select(F.col(row_id).alias("_r"), *[F.col(f"`{c}`").cast("double").alias(c) for c in (*x, time)], F.col(f"`{entity}`").alias("_e"), F.col(f"`{y}`").cast("double").alias(y)).na.drop()
    if rows.limit(least).count() < least:
        return None
    codes = numbered(rows.groupBy(F.col("_e").alias("_k")).agg(F.min("_r").alias("_first")), ["_first"], "entity_code").select("_k", F.col("entity_code").cast("double").alias("entity_code"))
    return rows.join(codes, F.col("_e") == F.col("_k")).select(F.col("_r").alias(row_id), *x, time, "entity_code", y)


def best_by_r2(fits: list[Fit], top: int = 72) -> list[Fit]:
    """TK1: the candidates that go on to the literature."""
    return sorted(fits, key=lambda f: (-f.r_squared, f.y, f.x))[:top]


def screening_warnings(n_rows: int, n_inputs: int, n_fits: int, strong: int, chosen: int) -> list[str]:
    """SE11: why a screening found nothing, or found little."""
    if not n_rows:
        return ["The segment has no rows."]
    if n_rows < 12:
        return ["Fewer than 12 rows in the segment."]
    if n_inputs < 2:
        return ["Fewer than two numeric inputs that vary."]
    if not n_fits:
        return ["No fit of the segment passed."]
    return ["The corpus says little about most fits; the best by statistics are shown."] if not strong and chosen else []


def bundles(ranked: DataFrame, run: str) -> DataFrame:
    """SE10: of fits (rank, y_col, x_cols, r_squared, lit_score, coefficients, p_values) a row each with ids that the same fit always gets.

    id, hypothesis_id (H1 ... in order of rank), y_col, primary_variables (ten at most), r_squared (4 digits), coefficients and p_values (6), priority_score and
    validation_passed (R2 and literature above their thresholds).
    """
    rounded = lambda c: F.transform_values(c, lambda k, v: F.round(v, 6))
    return ranked.select(
        F.substring(F.sha2(F.concat_ws("|", F.lit(run), "y_col", F.array_join("x_cols", ",")), 256), 1, 16).alias("id"),
        F.concat(F.lit("H"), F.col("rank").cast("string")).alias("hypothesis_id"),
        "y_col",
        F.slice("x_cols", 1, 10).alias("primary_variables"),
        F.round("r_squared", 4).alias("r_squared"),
        rounded(F.col("coefficients")).alias("coefficients"),
        rounded(F.col("p_values")).alias("p_values"),
        F.round(F.least(F.lit(1.0), F.col("lit_score")), 4).alias("priority_score"),
        ((F.col("r_squared") >= MIN_R2) & (F.col("lit_score") >= MIN_LITERATURE)).alias("validation_passed"),
        *[c for c in ("model_type", "diagnostic_score") if c in ranked.columns],
    )


def screen_grounded(df: DataFrame, inputs: list[str], outcomes: list[str], corpus: DataFrame, run: str, row_id: str, entity: str | None = None, time: str | None = None, embed=None, sizes: tuple[int, ...] = (2, 3, 5), top: int = 6) -> tuple[DataFrame, list[str]]:
    """SE5: bundles of the best fits by literature, R2 and diagnostics, and warnings.

    corpus: doc_id, embedding; embed: makes a text's vector of that kind (default: hashed words). One Gram pass fits all candidates, and
    with entity and time a fixed effects fit an outcome joins them; those of the greatest R2 (TK1) get diagnostics and a score
    by what the corpus holds nearest to a text of their columns.
    """
    from assaygrid.operators import within
    from assaygrid.operators.literature import literature_scores
    from assaygrid.operators.retrieval import hashed_embedding

    spark = df.sparkSession
    # read in five passes and more, computed once
    df, path = written(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*inputs, *outcomes, row_id, *[c for c in (entity, time) if c]])]), "rows")
    g = gram(df, list(dict.fromkeys([*inputs, *outcomes])))
    n = int(round(sum(m[0, 0] for m in g.sums.get((), {}).values())))
    some = n >= 12 and len(inputs) >= 2
    fits = [f for c in candidates(inputs, outcomes, sizes=sizes) if not correlated(g, c.x) and (f := solve(g, c.y, c.x)) and f.r_squared >= MIN_R2] if some else []
    panel = bool(entity and time) and some
    parts = within.panel_parts(df, inputs, outcomes, entity, [time, row_id], None, (time,)) if panel else {}
    effects = _panel_fits(df, inputs, outcomes, ["all"], entity, time, None, parts) if panel else []
    kept = best_by_r2(fits)
    found = _scored(df, kept, ["all"] * len(kept), g, row_id, None, parts) + effects
    remove(spark, path)
    found = sorted(found, key=lambda c: -c.r_squared)[:72]
    rows = [(i, c.y, c.x, c.model_type, c.r_squared, c.diagnostic, *c.maps()) for i, c in enumerate(found)]
    table = spark.createDataFrame(rows, "i int, y_col string, x_cols array<string>, model_type string, r_squared double, diagnostic_score double, coefficients map<string,double>, p_values map<string,double>")
    scored = literature_scores(table, corpus, embed=embed or hashed_embedding) if rows else table.withColumn("lit_score", F.lit(0.0))
    # 72 rows at most
    ranked = sorted((r.asDict() for r in scored.collect()), key=lambda r: (-r["lit_score"] * r["r_squared"] * r["diagnostic_score"], -r["lit_score"], -r["r_squared"], r["i"]))
    strong = [r for r in ranked if r["lit_score"] >= MIN_LITERATURE]
    chosen = (strong if len(strong) >= 2 else ranked)[:top]
    schema = "rank int, y_col string, x_cols array<string>, model_type string, r_squared double, lit_score double, diagnostic_score double, coefficients map<string,double>, p_values map<string,double>"
    out = spark.createDataFrame([(i, r["y_col"], r["x_cols"], r["model_type"], r["r_squared"], r["lit_score"], r["diagnostic_score"], r["coefficients"], r["p_values"]) for i, r in enumerate(chosen, 1)], schema)
    return bundles(out, run), screening_warnings(n, len(inputs), len(fits) + len(effects), len(strong), len(chosen))
