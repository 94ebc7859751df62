"""The panel half of the screening: within-entity fits of many candidates and what tells whether a panel is sound.

One aggregate by regime, entity and pattern of missing values holds counts, sums and products of all variables. A candidate
takes the patterns that have all it needs; its within matrix is the products less, for each entity, its sums' products over
its count. So any number of candidates and regimes share one pass over the rows, and all that follows is over entities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaygrid.functions.stats import f_sf, t_sf2
from assaygrid.operators.models import stationarity
from assaygrid.shared import written

#: A column varies within entities if this share of its variance is inside them.
LEAST_WITHIN = 0.05


@dataclass
class Moments:
    """entity rows (g, e, patterns: (mask, n, products of (1, z))) of shifted and scaled variables."""

    variables: list[str]
    shift: np.ndarray
    scale: np.ndarray
    table: DataFrame

    def sums(self, specs: list[tuple[str, list[str]]], size: int, visit) -> dict[int, np.ndarray]:
        """Of each spec (regime, variables): visit(spec, n, sums, products by entity), size numbers, added up over all entities."""
        at = {v: i for i, v in enumerate(self.variables)}
        q = len(self.variables) + 1
        picks = [([at[v] for v in names], sum(1 << at[v] for v in names)) for _, names in specs]
        regimes = [g for g, _ in specs]

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(specs), size))
            for batch in batches:
                group = np.array(batch.column(0).to_pylist(), dtype=object)
                patterns = batch.column(1)
                per = np.asarray(patterns.value_lengths()).astype(np.int64)
                flat = patterns.flatten()
                mask = flat.field("mask").to_numpy()
                m = flat.field("m").flatten().to_numpy().reshape(-1, q, q)
                owner = np.repeat(np.arange(len(per)), per)
                for i, (pick, need) in enumerate(picks):
                    ok = ((mask & need) == need) & (group[owner] == regimes[i])
                    if not ok.any():
                        continue
                    own = owner[ok]
                    heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    take = [0, *[p + 1 for p in pick]]
                    each = np.add.reduceat(m[ok][:, take][:, :, take], heads)
                    total[i] += visit(i, each[:, 0, 0], each[:, 0, 1:], each[:, 1:, 1:])
            fits, places = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(fits.astype(np.int32)), pa.array(places.astype(np.int32)), pa.array(total[fits, places])], ["fit", "at", "v"])

        out = {i: np.zeros(size) for i in range(len(specs))}
        # so many numbers a spec
        for r in self.table.select("g", "patterns").mapInArrow(summed, "fit int, at int, v double").groupBy("fit", "at").agg(F.sum("v").alias("v")).toLocalIterator():
            out[r["fit"]][r["at"]] = r["v"]
        return out


def regime_of(regime: str | None) -> Column:
    return F.coalesce(F.col(f"`{regime}`").cast("string"), F.lit("None")) if regime else F.lit("all")


def _finite(column: str) -> Column:
    x = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def entity_moments(df: DataFrame, variables: list[str], entity: str, regime: str | None = None) -> Moments:
    """Two passes (centre and spread, moments); rows without an entity are left out. Up to 62 variables."""
    if len(variables) > 62:
        raise ValueError("patterns of missing values are kept for 62 variables at most")
    clean = [_finite(v) for v in variables]
    rows = df.where(F.col(f"`{entity}`").isNotNull()).select(regime_of(regime).alias("g"), F.col(f"`{entity}`").alias("e"), *[x.alias(f"v{i}") for i, x in enumerate(clean)])
    k = range(len(variables))
    r = rows.agg(*[F.avg(f"v{i}").alias(f"m{i}") for i in k], *[F.stddev_pop(f"v{i}").alias(f"s{i}") for i in k]).first()
    shift, scale = np.array([r[f"m{i}"] or 0.0 for i in k]), np.array([r[f"s{i}"] or 1.0 for i in k])
    z = [F.coalesce((F.col(f"v{i}") - F.lit(float(shift[i]))) / F.lit(float(scale[i])), F.lit(0.0)) for i in k]
    mask = sum((F.when(F.col(f"v{i}").isNotNull(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i in k), F.lit(0).cast("long"))
    narrow = rows.select("g", "e", mask.alias("mask"), *[c.alias(f"z{i}") for i, c in enumerate(z)])
    one = [F.lit(1.0), *[F.col(f"z{i}") for i in k]]
    parts = {(i, j): f"p{i}_{j}" for i in range(len(one)) for j in range(i, len(one))}
    per = narrow.groupBy("g", "e", "mask").agg(*[F.sum(one[i] * one[j]).alias(name) for (i, j), name in parts.items()])
    matrix = F.array(*[F.col(parts[min(i, j), max(i, j)]) for i in range(len(one)) for j in range(len(one))])
    # as many patterns an entity as there are
    table, _ = written(per.groupBy("g", "e").agg(F.collect_list(F.struct("mask", matrix.alias("m"))).alias("patterns")), "moments")
    return Moments(variables, shift, scale, table)


@dataclass
class WithinFit:
    regime: str
    y: str
    x: list[str]
    n: int
    n_entities: int
    least_obs: int
    most_obs: int
    coefficients: dict[str, float]
    clustered_se: dict[str, float]
    p_values: dict[str, float]
    within_r2: float
    between_r2: float
    overall_r2: float
    f: float
    f_p: float
    rmse: float
    aic: float
    bic: float
    y_std: float

    @property
    def balanced(self) -> bool:
        return self.least_obs == self.most_obs


def within_fits(moments: Moments, specs: list[tuple[str, str, list[str]]], always: tuple[str, ...] = (), least_rows: int = 12, least_entities: int = 3) -> dict[int, WithinFit]:
    """MD3, DG27 of many (regime, y, x): fits with entity effects, errors clustered by entity, by the place of each in specs.

    Regressors with less than LEAST_WITHIN of their variance inside entities are left out but for those of always, and so are those
    that others absorb. Fits with too few rows or entities, or with no regressor, are not there. Two passes over entities, for all fits.
    """
    named = [(g, [*x, y]) for g, y, x in specs]
    most = max((len(v) for _, v in named), default=0)
    size = 2 * most * most + most + 6

    def spread(i: int, n: np.ndarray, s: np.ndarray, p: np.ndarray) -> np.ndarray:
        k = s.shape[1]
        out = np.zeros(size)
        out[: k * k] = (p - s[:, :, None] * s[:, None, :] / n[:, None, None]).sum(0).ravel()
        out[most * most : most * most + k * k] = p.sum(0).ravel()
        out[2 * most * most : 2 * most * most + k] = s.sum(0)
        out[-6:-3] = n.sum(), len(n), 0
        return out

    got = moments.sums(named, size, spread)
    at = {v: i for i, v in enumerate(moments.variables)}
    solved: dict[int, tuple] = {}
    for i, (_, names) in enumerate(named):
        k = len(names)
        w, t, s = got[i][: k * k].reshape(k, k), got[i][most * most : most * most + k * k].reshape(k, k), got[i][2 * most * most : 2 * most * most + k]
        n, groups = int(round(got[i][-6])), int(round(got[i][-5]))
        if n < least_rows or groups < least_entities:
            continue
        c = t - np.outer(s, s) / n
        keep: list[int] = []
        for j in range(k - 1):
            share = w[j, j] / c[j, j] if c[j, j] > 1e-9 * n else 0.0
            if names[j] not in always and share < LEAST_WITHIN or w[j, j] <= 1e-10 * max(c[j, j], 1e-300):
                continue
            rest = w[j, j] - w[j, keep] @ np.linalg.solve(w[np.ix_(keep, keep)], w[keep, j]) if keep else w[j, j]
            if rest > 1e-10 * w[j, j]:
                keep.append(j)
        if not keep or w[-1, -1] <= 0:
            continue
        inv = np.linalg.inv(w[np.ix_(keep, keep)])
        solved[i] = keep, inv, inv @ w[keep, -1], w, c, s / n, n, groups
    if not solved:
        return {}
    order = list(solved)

    def scores(i: int, n: np.ndarray, s: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The sandwich's middle, and sums of entity means' residuals and outcomes, with the counts' least and most as powers."""
        keep, _, b, _, _, mean, _, _ = solved[order[i]]
        inside = p - s[:, :, None] * s[:, None, :] / n[:, None, None]
        score = inside[:, keep, -1] - inside[:, keep][:, :, keep] @ b
        means = s / n[:, None] - mean
        off = means[:, -1] - means[:, keep] @ b
        out = np.zeros(size)
        k = len(keep)
        out[: k * k] = (score.T @ score).ravel()
        y = means[:, -1]
        out[-6:-3] = (off * off).sum(), (y * y).sum(), y.sum()
        return out

    second = moments.sums([named[i] for i in order], size, scores)
    counts = _counts(moments, [named[i] for i in order])
    fits = {}
    for place, i in enumerate(order):
        keep, inv, b, w, c, _, n, groups = solved[i]
        names, k = named[i][1], len(keep)
        sy = moments.scale[at[names[-1]]]
        sx = np.array([moments.scale[at[names[j]]] for j in keep])
        meat = second[place][: k * k].reshape(k, k)
        covariance = inv @ meat @ inv * groups / (groups - 1)
        beta, se = b * sy / sx, np.sqrt(np.maximum(np.diag(covariance), 0)) * sy / sx
        sse = max(float(w[-1, -1] - b @ w[keep, -1]), 0.0)
        within = 1 - sse / w[-1, -1]
        overall = 1 - float(c[-1, -1] - 2 * b @ c[keep, -1] + b @ c[np.ix_(keep, keep)] @ b) / c[-1, -1]
        off, yy, y = second[place][-6:-3]
        spread_of_means = yy - y * y / groups
        between = 1 - off / spread_of_means if spread_of_means > 0 else 0.0
        df = max(n - groups - k, 1)
        f = within / k / ((1 - within) / df) if within < 1 else math.inf
        kept = [names[j] for j in keep]
        as_map = lambda v, kept=kept: dict(zip(kept, map(float, v), strict=True))
        units = sse * sy * sy
        ll = -n / 2 * (math.log(2 * math.pi * max(units, 1e-300) / n) + 1)
        p = [t_sf2(float(v / e) if e > 0 else math.inf, groups - 1) for v, e in zip(beta, se, strict=True)]
        fits[i] = WithinFit(named[i][0], names[-1], kept, n, groups, *counts[place], as_map(beta), as_map(se), as_map(p), float(within), float(between), float(overall), float(f), f_sf(f, k, df), math.sqrt(units / n), -2 * ll + 2 * (k + 1), -2 * ll + math.log(n) * (k + 1), float(math.sqrt(c[-1, -1] / (n - 1)) * sy))
    return fits


def _counts(moments: Moments, specs: list[tuple[str, list[str]]]) -> list[tuple[int, int]]:
    """The least and the most rows that an entity has for each spec."""
    if not specs:
        return []
    at = {v: i for i, v in enumerate(moments.variables)}
    parts = []
    for i, (g, names) in enumerate(specs):
        n = _rows_with(sum(1 << at[v] for v in names))
        n = F.when((F.col("g") == g) & (n > 0), n)
        parts += [F.min(n).alias(f"a{i}"), F.max(n).alias(f"b{i}")]
    r = moments.table.agg(*parts).first()
    return [(int(r[f"a{i}"] or 0), int(r[f"b{i}"] or 0)) for i in range(len(specs))]


def _rows_with(need: int) -> Column:
    """How many rows an entity has that hold all that is needed."""
    return F.aggregate("patterns", F.lit(0.0), lambda s, p: s + F.when(p["mask"].bitwiseAND(F.lit(need).cast("long")) == need, p["m"][0]).otherwise(0.0))


@dataclass
class PanelParts:
    """Of one regime: columns that vary within entities, whether each one's demeaned series is stationary (None: not tested), and each outcome's ICC."""

    within: list[str] = field(default_factory=list)
    stationary: dict[str, bool | None] = field(default_factory=dict)
    icc: dict[str, float] = field(default_factory=dict)

    def adf_fraction(self, columns: list[str]) -> float | None:
        tested = [self.stationary[c] for c in columns if self.stationary.get(c) is not None]
        return round(sum(tested) / len(tested), 4) if tested else None


def panel_parts(df: DataFrame, pool: list[str], outcomes: list[str], entity: str, order: list[str], regime: str | None = None, tested: tuple[str, ...] = ()) -> dict[str, PanelParts]:
    """FL8, DG11, DG12 of every regime: one aggregate by entity for all shares and ICCs, and one numbering for all series.

    tested: columns whose series are tested too, whatever their share within entities. ICC: the variance of entity means over rows, over the outcome's.
    """
    names = list(dict.fromkeys([*pool, *outcomes]))
    g, e = regime_of(regime).alias("g"), F.col(f"`{entity}`").alias("e")
    d = [_finite(c) for c in names]
    centre = df.agg(*[F.avg(x).alias(f"c{i}") for i, x in enumerate(d)]).first()
    rows = df.select(g, e, *[(x - F.lit(centre[f"c{i}"] or 0.0)).alias(f"v{i}") for i, x in enumerate(d)])
    k = range(len(names))
    per = rows.groupBy("g", "e").agg(F.count("*").alias("rows"), *[F.count(f"v{i}").alias(f"n{i}") for i in k], *[F.avg(f"v{i}").alias(f"m{i}") for i in k], *[F.sum(F.col(f"v{i}") ** 2).alias(f"q{i}") for i in k])
    known = F.col("e").isNotNull()
    sums = []
    for i in k:
        n, m, q = F.col(f"n{i}"), F.col(f"m{i}"), F.col(f"q{i}")
        weight = F.when(known & (n > 0), F.col("rows"))
        sums += [F.sum(n).alias(f"n{i}"), F.sum(n * m).alias(f"s{i}"), F.sum(q).alias(f"q{i}"), F.sum(F.when(known, n)).alias(f"k{i}"), F.sum(F.when(known, q - n * m * m)).alias(f"w{i}"), F.sum(weight).alias(f"r{i}"), F.sum(weight * m).alias(f"rm{i}"), F.sum(weight * m * m).alias(f"rq{i}")]
    out: dict[str, PanelParts] = {}
    for r in per.groupBy("g").agg(*sums).toLocalIterator():  # a row a regime
        part = out[r["g"]] = PanelParts()
        for i, c in enumerate(names):
            n = r[f"n{i}"]
            if n < 2:
                continue
            total = (r[f"q{i}"] - r[f"s{i}"] ** 2 / n) / (n - 1)
            if c in pool and total >= 1e-9 and r[f"k{i}"] > 1 and (r[f"w{i}"] / (r[f"k{i}"] - 1)) / total >= LEAST_WITHIN:
                part.within.append(c)
            if c in outcomes and total > 1e-9 and (r[f"r{i}"] or 0) > 1:
                part.icc[c] = round((r[f"rq{i}"] - r[f"rm{i}"] ** 2 / r[f"r{i}"]) / (r[f"r{i}"] - 1) / total, 4)
    columns = [c for c in dict.fromkeys([*tested, *pool]) if c in tested or any(c in p.within for p in out.values())]
    if columns:
        for r in stationarity(df, columns, entity, order, by=regime).toLocalIterator():  # a row a regime and column
            if r["regime"] in out:
                out[r["regime"]].stationary[r["column"]] = None if r["n"] < 10 or r["p"] is None or math.isnan(r["p"]) else r["p"] < 0.05
    return out
