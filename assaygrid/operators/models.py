"""Model operators beyond plain least squares: panel effects, penalized paths, trees, two stages, groups and mixtures."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor  # noqa: F401  GBTRegressor: what tests hold boosted trees against
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaygrid.functions.stats import adf_lags, adf_of, adf_rows, chi2_sf, f_sf, shapiro, t_sf2
from assaygrid.operators.fold_boosting import boost_folds
from assaygrid.operators.order import in_blocks, numbered
from assaygrid.operators.panel import first_values
from assaygrid.operators.profile import safe_corr
from assaygrid.operators.screening import Fit, Gram, complete, gram, solve
from assaygrid.shared import remove, written


def _d(c: str):
    return F.col(f"`{c}`").cast("double")


@dataclass
class PanelFit:
    y: str
    x: list[str]
    n: int
    n_entities: int
    coefficients: dict[str, float]
    clustered_se: dict[str, float]
    p_values: dict[str, float]
    within_r2: float
    between_r2: float
    overall_r2: float
    f: float
    f_p: float
    covariance: np.ndarray
    sigma2_e: float


def fixed_effects(df: DataFrame, y: str, x: list[str], entity: str, least_within: float = 0.05) -> PanelFit | None:
    """MD3: the within estimator on complete rows, errors clustered by entity.

    Regressors whose within variance is less than least_within of their total are left out; 12 rows and 3 entities at
    least. The sandwich has the factor G / (G - 1). One aggregate by entity holds its sums of products; rows of a large
    entity are summed where they lie. All else is over entities.
    """
    names = [*x, y]
    rows = df.select(F.col(f"`{entity}`").alias("_e"), *[_d(c).alias(f"v{i}") for i, c in enumerate(names)]).na.drop()
    centre = rows.agg(*[F.avg(f"v{i}").alias(f"v{i}") for i in range(len(names))]).first()
    shifted = rows.select("_e", *[(F.col(f"v{i}") - F.lit(centre[f"v{i}"] or 0.0)).alias(f"v{i}") for i in range(len(names))])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    per = shifted.groupBy("_e").agg(F.count("*").alias("n"), *[F.avg(f"v{i}").alias(f"m{i}") for i in range(len(names))], *[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"s{i}_{j}") for i, j in pairs])
    inside = lambda i, j: F.col(f"s{min(i, j)}_{max(i, j)}") - F.col("n") * F.col(f"m{i}") * F.col(f"m{j}")
    per = per.persist()
    try:
        r = per.agg(F.sum("n").alias("n"), F.count("*").alias("g"), *[F.sum(inside(i, j)).alias(f"w{i}_{j}") for i, j in pairs], *[F.sum(f"s{i}_{j}").alias(f"t{i}_{j}") for i, j in pairs]).first()
        n, groups = r["n"] or 0, r["g"]
        matrix = lambda p: np.array([[float(r[f"{p}{min(i, j)}_{max(i, j)}"] or 0.0) for j in range(len(names))] for i in range(len(names))])
        within, total = matrix("w"), matrix("t")
        keep = [i for i in range(len(x)) if total[i, i] > 0 and within[i, i] / total[i, i] >= least_within]
        if n < 12 or groups < 3 or not keep:
            return None
        k, last = len(keep), len(x)
        sxy, yy = within[keep, last], within[last, last]
        inv = np.linalg.pinv(within[np.ix_(keep, keep)])
        b = inv @ sxy
        sse = max(float(yy - b @ sxy), 0.0)
        # an entity's score: its products of regressors and residuals
        score = [inside(i, last) - sum((F.lit(float(v)) * inside(i, j) for j, v in zip(keep, b, strict=True)), F.lit(0.0)) for i in keep]
        line = sum((F.lit(float(v)) * F.col(f"m{i}") for i, v in zip(keep, b, strict=True)), F.lit(0.0))
        meat = per.agg(*[F.sum(score[i] * score[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)], safe_corr(line, F.col(f"m{last}")).alias("r")).first()
    finally:
        per.unpersist()
    m = np.array([[meat[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    covariance = inv @ m @ inv * groups / (groups - 1)
    se = np.sqrt(np.maximum(np.diag(covariance), 0))
    df_e = max(n - groups - k, 1)
    within_r2 = float(1 - sse / yy) if yy > 0 else 0.0
    along, spread = float(b @ total[keep, last]), float(b @ total[np.ix_(keep, keep)] @ b) * total[last, last]
    f = (within_r2 / k) / ((1 - within_r2) / df_e) if within_r2 < 1 else math.inf
    p = [t_sf2(float(v / s) if s > 0 else math.inf, groups - 1) for v, s in zip(b, se, strict=True)]
    kept = [x[i] for i in keep]
    named = lambda v: dict(zip(kept, [float(q) for q in v], strict=True))
    return PanelFit(y, kept, n, groups, named(b), named(se), named(p), within_r2, (meat["r"] or 0.0) ** 2, along**2 / spread if spread > 0 else 0.0, f, f_sf(f, k, df_e), inv * sse / df_e, sse / df_e)


def random_effects(df: DataFrame, y: str, x: list[str], entity: str) -> Fit | None:
    """MD4: generalized least squares by quasi-demeaning, with variance parts from the within and between fits."""
    rows = df.select(F.col(f"`{entity}`").alias("_e"), *[_d(c).alias(c) for c in (*x, y)]).na.drop()
    fe = fixed_effects(df, y, x, entity, least_within=0.0)
    if fe is None:
        return None
    means = rows.groupBy("_e").agg(F.count("*").alias("_t"), *[F.avg(c).alias(c) for c in (*x, y)])
    between = solve(gram(means, [*x, y]), y, tuple(x))
    if between is None:
        return None
    t_bar = fe.n_entities / (means.agg(F.sum(1 / F.col("_t")).alias("s")).first()["s"])
    sigma2_u = max(0.0, between.sse / max(between.n - between.rank - 1, 1) - fe.sigma2_e / t_bar)
    over = Window.partitionBy("_e")
    theta = 1 - F.sqrt(F.lit(fe.sigma2_e) / (F.count("*").over(over) * F.lit(sigma2_u) + F.lit(fe.sigma2_e)))
    quasi = rows.select((1 - theta).alias("_one"), *[(F.col(c) - theta * F.avg(c).over(over)).alias(c) for c in (*x, y)])
    g = gram(quasi, ["_one", *x, y])
    # the constant is quasi-demeaned too, so the fit has no further intercept: normal equations of raw moments
    m = complete(g, ["_one", *x, y])
    s, shift = g.scale, g.shift
    t = np.zeros((len(s) + 1, len(s) + 1))
    t[0, 0], t[1:, 0], t[1:, 1:] = 1, shift, np.diag(s)
    raw = t @ m @ t.T
    k, n = len(x) + 1, int(round(m[0, 0]))
    inv = np.linalg.pinv(raw[1 : k + 1, 1 : k + 1])
    b = inv @ raw[1 : k + 1, -1]
    sse = max(float(raw[-1, -1] - b @ raw[1 : k + 1, -1]), 0.0)
    s2 = sse / max(n - k, 1)
    se = np.sqrt(np.maximum(np.diag(inv) * s2, 0))
    names = ["const", *x]
    sst = raw[-1, -1] - raw[0, -1] ** 2 / n
    r2 = 1 - sse / sst if sst > 0 else 0.0
    p = [t_sf2(float(v / e) if e > 0 else math.inf, n - k) for v, e in zip(b, se, strict=True)]
    as_map = lambda v: dict(zip(names, [float(q) for q in v], strict=True))
    return Fit(y, tuple(x), n, as_map(b), as_map(se), as_map(p), r2, 1 - (1 - r2) * (n - 1) / max(n - k, 1), math.nan, math.nan, math.nan, math.nan, math.nan, math.nan, sse, k - 1, inv)


def hausman(fe: PanelFit, re: Fit) -> tuple[float, float] | None:
    """MD5: statistic and p-value over common coefficients; None if the statistic is negative."""
    common = [c for c in fe.x if c in re.coefficients]
    i, j = [fe.x.index(c) for c in common], [list(re.coefficients).index(c) for c in common]
    d = np.array([fe.coefficients[c] - re.coefficients[c] for c in common])
    covariance = re.inverse * re.sse / max(re.n - re.rank - 1, 1)
    stat = float(d @ np.linalg.pinv(fe.covariance[np.ix_(i, i)] - covariance[np.ix_(j, j)]) @ d)
    return (stat, chi2_sf(stat, len(common))) if stat >= 0 else None


def _standard(g: Gram, y: str, x: list[str], group: tuple = ()) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Correlations of x, of x and y, variance of y, n."""
    m = complete(g, [*x, y], group)
    n = m[0, 0]
    c = m[1:, 1:] / n - np.outer(m[0, 1:], m[0, 1:]) / n**2
    d = np.sqrt(np.maximum(np.diag(c), 1e-300))
    r = c / np.outer(d, d)
    return r[:-1, :-1], r[:-1, -1], float(c[-1, -1] * g.scale[g.variables.index(y)] ** 2), int(round(n))


def coordinate_descent(r: np.ndarray, ry: np.ndarray, alpha: float, l1: float = 1.0, start: np.ndarray | None = None) -> np.ndarray:
    """The penalized fit on standardized variables from their correlations."""
    b = np.zeros(len(ry)) if start is None else start.copy()
    for _ in range(2000):
        most = 0.0
        for j in range(len(b)):
            z = ry[j] - r[j] @ b + r[j, j] * b[j]
            fresh = math.copysign(max(abs(z) - alpha * l1, 0.0), z) / (r[j, j] + alpha * (1 - l1))
            most = max(most, abs(fresh - b[j]))
            b[j] = fresh
        if most < 1e-10:
            break
    return b


def _folds(df: DataFrame, y: str, x: list[str], row_id: str, folds: int) -> Gram:
    rows = df.select(F.col(row_id).alias("_r"), *[_d(c).alias(c) for c in (*x, y)]).na.drop()
    return gram(rows.withColumn("fold", F.pmod(F.xxhash64("_r"), F.lit(folds)).cast("string")), [*x, y], ["fold"])


def lasso_cv(df: DataFrame, y: str, x: list[str], row_id: str, l1: float = 1.0, folds: int = 5, path: int = 50) -> dict:
    """MD6, MD8: the penalty of least cross-validated error over a path, all from fold Grams (one pass over rows).

    Returns alpha, standardized coefficients, nonzero, sparsity and cv_r2.
    """
    g = _folds(df, y, x, row_id, folds)
    whole = Gram(g.variables, g.shift, g.scale, {(): {-1: sum(m for masks in g.sums.values() for m in masks.values())}})
    whole.sums[()] = {(1 << len(g.variables)) - 1: whole.sums[()][-1]}
    r, ry, _, n = _standard(whole, y, x)
    top = float(np.abs(ry).max()) / l1 if len(ry) else 0.0
    alphas = top * np.logspace(0, -3, path) if top > 0 else np.array([1.0])
    errors = np.zeros(len(alphas))
    for held in g.sums:
        rest = {(): {(1 << len(g.variables)) - 1: whole.sums[()][(1 << len(g.variables)) - 1] - sum(g.sums[held].values())}}
        rr, ry_r, _, n_r = _standard(Gram(g.variables, g.shift, g.scale, rest), y, x)
        m, out = sum(rest[()].values()), sum(g.sums[held].values())
        mean, sd = m[0, 1:] / n_r, np.sqrt(np.maximum(np.diag(m)[1:] / n_r - (m[0, 1:] / n_r) ** 2, 1e-300))
        b = None
        for i, a in enumerate(alphas):
            b = coordinate_descent(rr, ry_r, float(a), l1, b)
            beta = b * sd[-1] / sd[:-1]
            w = np.array([-(mean[-1] - beta @ mean[:-1]), *-beta, 1.0])
            errors[i] += float(w @ out @ w)
    best = int(np.argmin(errors))
    b = coordinate_descent(r, ry, float(alphas[best]), l1)
    m = whole.sums[()][(1 << len(g.variables)) - 1]
    sst = m[-1, -1] - m[0, -1] ** 2 / n
    nonzero = int((np.abs(b) > 0.01).sum())
    return {"alpha": float(alphas[best]), "coefficients": dict(zip(x, b.tolist(), strict=True)), "nonzero": nonzero, "sparsity": 1 - nonzero / max(len(x), 1), "cv_r2": float(1 - errors[best] / sst) if sst > 0 else 0.0, "n": n}


def ridge_cv(df: DataFrame, y: str, x: list[str], row_id: str, folds: int = 5) -> dict:
    """MD7: of 50 penalties from 1e-3 to 1e4 the one of least cross-validated error; effective degrees of freedom, shrinkage, condition number."""
    g = _folds(df, y, x, row_id, folds)
    full = (1 << len(g.variables)) - 1
    total = sum(m for masks in g.sums.values() for m in masks.values())
    alphas = np.logspace(-3, 4, 50)

    def parts(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = m[0, 0]
        c = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / n
        return c[:-1, :-1], c[:-1, -1], m[0, 1:] / n

    errors = np.zeros(len(alphas))
    for masks in g.sums.values():
        out = sum(masks.values())
        sxx, sxy, mean = parts(total - out)
        for i, a in enumerate(alphas):
            b = np.linalg.solve(sxx + a * np.eye(len(x)), sxy)
            w = np.array([-(mean[-1] - b @ mean[:-1]), *-b, 1.0])
            errors[i] += float(w @ out @ w)
    best = int(np.argmin(errors))
    sxx, sxy, _ = parts(total)
    s = np.linalg.eigvalsh(sxx)
    b, ols = np.linalg.solve(sxx + alphas[best] * np.eye(len(x)), sxy), np.linalg.pinv(sxx) @ sxy
    sst = total[-1, -1] - total[0, -1] ** 2 / total[0, 0]
    return {"alpha": float(alphas[best]), "effective_df": float((s / (s + alphas[best])).sum()), "shrinkage": 1 - float(np.linalg.norm(b) / max(np.linalg.norm(ols), 1e-300)), "condition": math.sqrt(max(s[-1], 0) / s[0]) if s[0] > 0 else math.inf, "cv_r2": float(1 - errors[best] / sst) if sst > 0 else 0.0, "mask": full}


def _filled(df: DataFrame, y: str, x: list[str], *more: str) -> DataFrame:
    rows = df.select(*[F.when(~F.isnan(_d(c)), _d(c)).alias(c) for c in (*x, y)], *more).where(F.col(f"`{y}`").isNotNull())
    # trees take missing values as a value of their own, with an indicator beside it
    return rows.withColumns({f"{c}_missing": F.col(f"`{c}`").isNull().cast("double") for c in x} | {c: F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in x})


def _assembled(df: DataFrame, y: str, x: list[str], *more: str) -> DataFrame:
    return VectorAssembler(inputCols=[*x, *[f"{c}_missing" for c in x]], outputCol="features").transform(_filled(df, y, x, *more)).select("features", F.col(y).alias("label"), *more)


def tree_model(df: DataFrame, y: str, x: list[str], kind: str = "gbt", seed: int = 42, folds: int = 5, **options) -> dict:
    """MD9, MD10: a forest (24 trees of depth 6) by MLlib or boosted trees (200 of depth 3, steps of 0.05), as MLlib grows them, on all rows.

    Importances, R2, cv_r2 and their gap. cv_r2 is the mean R2 of folds (at most a fifth of the rows' number, 2 at
    least), each by a fit on the others; a row's fold hangs on a hash of its values alone, not on where it lies, so
    equal rows share a fold. Boosted trees of all fits grow side by side (operators/fold_boosting.py).
    """
    hashed = F.xxhash64(*[_d(c) for c in (*x, y)], F.lit(seed)).alias("h")
    given = df.select(*[F.col(f"`{c}`") for c in (*x, y)], hashed)
    return _boosted(given, y, x, folds, **options) if kind == "gbt" else _forest(given, y, x, seed, folds, **options)


def _boosted(given: DataFrame, y: str, x: list[str], folds: int, maxIter: int = 200, maxDepth: int = 3, stepSize: float = 0.05, maxBins: int = 32) -> dict:
    names = [f"x{i}" for i in range(2 * len(x))]
    rows, path = written(_filled(given, y, x, "h").select("h", F.col(f"`{y}`").alias("y"), *[F.col(f"`{c}`").alias(n) for c, n in zip([*x, *[f"{c}_missing" for c in x]], names, strict=True)]), "rows")
    folds = min(folds, max(2, rows.count() // 5))
    b = boost_folds(rows.select(F.pmod("h", F.lit(folds)).cast("int").alias("fold"), "y", *names), names, folds, maxIter, maxDepth, stepSize, maxBins)
    remove(rows.sparkSession, path)
    if b is None:
        raise ValueError(f"no rows with {y}")
    share = b.gains / (b.gains.sum() or 1.0)
    r_squared, cv = b.r_squared or 0.0, float(np.mean(b.held)) if b.held else 0.0
    return {"importances": {c: float(share[i] + share[len(x) + i]) for i, c in enumerate(x)}, "r_squared": r_squared, "cv_r2": cv, "gap": r_squared - cv}


#: Rows up to which the fits of a forest run side by side.
BESIDE = 500_000


def _forest(given: DataFrame, y: str, x: list[str], seed: int, folds: int, **options) -> dict:
    rows, path = written(_filled(given, y, x, "h"), "rows")
    data = VectorAssembler(inputCols=[*x, *[f"{c}_missing" for c in x]], outputCol="features").transform(rows).select("features", F.col(y).alias("label"), "h").persist()
    n = data.count()
    folds = min(folds, max(2, n // 5))

    def fit(part: DataFrame):
        return RandomForestRegressor(seed=seed, **({"numTrees": 24, "maxDepth": 6} | options)).fit(part)

    def r2(fitted, part: DataFrame) -> float | None:
        r = fitted.transform(part).agg(F.sum((F.col("label") - F.col("prediction")) ** 2).alias("sse"), (F.var_pop("label") * F.count("*")).alias("sst")).first()
        return 1 - r["sse"] / r["sst"] if r["sst"] else None

    def held(i: int) -> float | None:
        mine = F.pmod("h", F.lit(folds)) == i
        rest = data.where(~mine)
        return r2(fit(rest), data.where(mine)) if rest.head(1) else None

    # fits of few rows wait for the driver most of the time, so they run side by side; each keeps its rows in memory, so those of many run in turn
    with ThreadPoolExecutor(folds + 1 if n <= BESIDE else 1) as pool:
        whole = pool.submit(fit, data)
        scores = [v for v in pool.map(held, range(folds)) if v is not None]
        fitted = whole.result()
    r_squared, cv = r2(fitted, data) or 0.0, float(np.mean(scores)) if scores else 0.0
    data.unpersist()
    remove(rows.sparkSession, path)
    importance = fitted.featureImportances.toArray()
    return {"importances": {c: float(importance[i] + importance[len(x) + i]) for i, c in enumerate(x)}, "r_squared": r_squared, "cv_r2": cv, "gap": r_squared - cv}


def tree_score(gap: float, cv: float) -> float:
    """DG14."""
    return (1 - min(max((gap - 0.05) / 0.25, 0.0), 1.0)) * (0.3 if cv < 0 else 1.0)


def two_stage_score(stage1: float, stage2: float, entities: int) -> float:
    """DG15."""
    return (0.5 * min(1.0, stage1 / 0.6) + 0.5 * min(1.0, stage2 / 0.6)) * (0.8 if entities < 10 else 1.0)


def lasso_score(cv: float, sparsity: float) -> float:
    """DG16."""
    return 0.6 * min(max(cv, 0.0), 1.0) + 0.4 * sparsity


def elastic_net(df: DataFrame, y: str, x: list[str], alpha: float = 0.01, l1: float = 0.5) -> dict:
    """MD8 by MLlib."""
    data = VectorAssembler(inputCols=x, outputCol="features").transform(df.select(*[_d(c).alias(c) for c in (*x, y)]).na.drop()).select("features", F.col(y).alias("label"))
    m = LinearRegression(regParam=alpha, elasticNetParam=l1).fit(data)
    return {"coefficients": dict(zip(x, m.coefficients.toArray().tolist(), strict=True)), "intercept": m.intercept, "r_squared": m.summary.r2}


def _cells(rows: DataFrame, values: list[str]) -> DataFrame:
    """e, c: of each entity an array of (ti, n, s: sums of the values, d: their means less the mean of the time's means), by time."""
    sums = rows.groupBy("e", "ti").agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in values]).alias("s"))
    sums = sums.withColumn("m", F.transform("s", lambda v: v / F.col("n")))
    means = sums.groupBy(F.col("ti").alias("_ti")).agg(F.array(*[F.avg(F.col("m")[i]) for i in range(len(values))]).alias("_m"))
    cell = F.struct(F.col("ti").cast("int").alias("ti"), "n", "s", F.zip_with("m", "_m", lambda u, v: u - v).alias("d"))
    return sums.join(means, F.col("ti") == F.col("_ti")).select("e", cell.alias("c")).groupBy("e").agg(F.array_sort(F.collect_list("c")).alias("c"))


def _profiles(cells: DataFrame, weights: list[float], n_times: int) -> DataFrame:
    """e, c, features: weighted sums of the values' means by entity and time, less the mean of the time's means.

    A missing time takes the time's mean, which is zero here; so profiles are sparse and an entity holds its own times alone.
    """
    sparse = F.udf(lambda at, u: Vectors.sparse(n_times, at, u), VectorUDT())
    residual = F.transform("c", lambda c: sum((F.lit(w) * c["d"][i] for i, w in enumerate(weights)), F.lit(0.0)))
    return cells.select("e", "c", sparse("c.ti", residual).alias("features"))


def _clusters(data: DataFrame, k: int, seed: int, starts: int):
    """The k-means of least cost over several starts."""

    def start(i: int):
        model = KMeans(k=k, seed=seed + i).fit(data)
        return model.summary.trainingCost, i, model

    with ThreadPoolExecutor(starts) as pool:  # they wait for the driver most of the time
        return min(pool.map(start, range(starts)), key=lambda f: f[:2])[2]


def _by_group(model, data: DataFrame, width: int) -> DataFrame:
    """g, ti, n, s: the cells of a group's entities summed by time."""
    long = model.transform(data.select("e", "c", "features")).select(F.col("prediction").alias("g"), F.explode("c").alias("c"))
    return long.groupBy("g", F.col("c.ti").alias("ti")).agg(F.sum("c.n").alias("n"), F.array(*[F.sum(F.col("c.s")[i]) for i in range(width)]).alias("s"))


def grouped_fixed_effects(df: DataFrame, y: str, x: list[str], entity: str, time: str, most: int = 5, rounds: int = 20, seed: int = 42, starts: int = 10) -> dict:
    """MD16: entities in K groups with time effects of their own: fit, cluster residual profiles, fit with group and time means, until groups stay.

    K of 2 to most by the least BIC; each clustering is the best of several starts. Times are numbered in ranges, rows are
    summed by entity and time once, and turns work on these sums: profiles are sparse, and a fit takes the sums of groups
    by time off one Gram matrix, so no task or driver holds the times of all entities. All K run side by side.
    Centres of clusters hold K numbers a time. Returns k, bic, aic, r_squared, sse, coefficients (of inputs as given),
    standardized ones, n_times, converged, n_iterations, and two tables: assignments (entity, group) and effects (group,
    time, effect), groups from 1.
    """
    rows = df.select(F.col(f"`{entity}`").alias("e"), F.col(f"`{time}`").alias("t"), *[_d(c).alias(c) for c in (*x, y)]).na.drop()
    times, _ = written(numbered(rows.select("t").distinct(), ["t"], "ti"), "times")
    n_times = times.count()
    rows = rows.join(times, "t").persist()
    values = [*x, y]
    g = gram(rows, values)
    start = solve(g, y, tuple(x))
    raw = rows.agg(F.count("*").alias("n"), (F.var_pop(y) * F.count("*")).alias("sst"), *[F.stddev_pop(c).alias(f"s_{c}") for c in x]).first()
    # shifted and scaled, so that sums of squares keep their digits
    scaled = rows.select("e", "ti", *[((F.col(c) - F.lit(float(m))) / F.lit(float(s))).alias(c) for c, m, s in zip(values, g.shift, g.scale, strict=True)])
    cells, _ = written(_cells(scaled, values), "cells")
    rows.unpersist()
    cells = cells.persist()
    entities = cells.count()
    n, size, full = raw["n"], len(values), (1 << len(values)) - 1
    pairs = [(i, j) for i in range(size) for j in range(i, size)]

    def fitted(model, data: DataFrame) -> Fit | None:
        """Least squares on what groups and times leave: the rows' Gram matrix less the sums of groups by time."""
        taken = _by_group(model, data, size).agg(*[F.sum(F.col("s")[i] * F.col("s")[j] / F.col("n")) for i, j in pairs]).first()
        m = complete(g, values).copy()
        m[0, 1:] = m[1:, 0] = 0.0
        for (i, j), v in zip(pairs, taken, strict=True):
            m[i + 1, j + 1] -= v
            m[j + 1, i + 1] = m[i + 1, j + 1]
        return solve(Gram(values, np.zeros(size), g.scale, {(): {full: m}}), y, tuple(x))

    def turns(k: int) -> tuple | None:
        fit, before, settled, turn, kept = start, None, False, 0, None
        for turn in range(1, rounds + 1):
            # y less slopes times x, in units of y
            weights = [*(-fit.coefficients[c] * float(g.scale[i]) for i, c in enumerate(x)), float(g.scale[-1])]
            data = _profiles(cells, weights, n_times).persist()
            model = _clusters(data, k, seed, starts)
            fit = fitted(model, data)
            data.unpersist()
            if fit is None:
                return None
            # equal groups give equal slopes
            kept, now = (model, weights), [round(v, 6) for v in fit.coefficients.values()]
            settled = now == before
            if settled:
                break
            before = now
        return fit, settled, turn, *kept

    best: dict = {}
    tried = range(2, min(most, entities - 1) + 1) if start is not None else ()
    with ThreadPoolExecutor(max(1, len(tried))) as pool:  # they wait for the driver most of the time
        found = list(pool.map(turns, tried))
    for k, got in zip(tried, found, strict=True):
        if got is None:
            continue
        fit, settled, turn, model, weights = got
        parameters = k * n_times + len(x)
        fall = n * (math.log(2 * math.pi) + math.log(max(fit.sse, 1e-300) / n) + 1)
        if best and best["bic"] <= fall + parameters * math.log(n):
            continue
        best = {
            "k": k,
            "bic": fall + parameters * math.log(n),
            "aic": fall + 2 * parameters,
            "r_squared": 1 - fit.sse / raw["sst"] if raw["sst"] else 0.0,
            "coefficients": {c: fit.coefficients[c] for c in x},
            "standardized": {c: fit.coefficients[c] * raw[f"s_{c}"] for c in x},
            "sse": fit.sse,
            "n_times": n_times,
            "converged": settled,
            "n_iterations": turn,
            "_groups": (model, weights),
        }
    if best:
        model, weights = best.pop("_groups")
        data = _profiles(cells, weights, n_times)
        best["assignments"], _ = written(model.transform(data).select(F.col("e").alias("entity"), (F.col("prediction") + 1).alias("group")), "groups")
        mean = lambda i: F.col("s")[i] / F.col("n") * F.lit(float(g.scale[i])) + F.lit(float(g.shift[i]))
        level = mean(size - 1) - sum((F.lit(best["coefficients"][c]) * mean(i) for i, c in enumerate(x)), F.lit(0.0))
        effects = _by_group(model, data, size).withColumn("effect", level).join(times.withColumnRenamed("ti", "_ti"), F.col("ti") == F.col("_ti"))
        best["effects"], _ = written(effects.select((F.col("g") + 1).alias("group"), F.col("t").alias("time"), "effect"), "groups")
    cells.unpersist()
    return best


#: Rows of a task that takes part in every round of a mixture.
SHARE = 500_000
#: Numbers that tasks may pass to the driver in a round as they are; more are summed by a shuffle before.
GATHERED = 2_000_000


def mixture(df: DataFrame, y: str, x: list[str], time: str, most: int = 5, rounds: int = 100, seed: int = 42, tol: float = 1e-4) -> dict:
    """MD17: a mixture of linear regressions by expectation-maximization; K of 2 to most by the least BIC.

    Regimes have a softmax gate on the inputs, slopes (least squares at each time, averaged by weight) and an effect of
    each time. Inputs are standardized. A K ends when the log-likelihood moves by less than tol, or after rounds; one
    whose regime loses all its weight is left out. A round is one pass for every K: responsibilities and weighted
    Grams by time are summed in the workers and solved on the driver.
    """
    import pyarrow as pa

    rows = df.select(*[_d(c).alias(f"_v{i}") for i, c in enumerate((*x, y, time))]).na.drop()
    p = len(x)
    stats = rows.agg(F.count("*").alias("n"), *[F.avg(f"_v{i}").alias(f"m{i}") for i in range(p)], *[F.stddev_pop(f"_v{i}").alias(f"s{i}") for i in range(p)]).first()
    n = stats["n"]
    if n < 20:
        raise ValueError(f"{n} complete rows, 20 are needed")
    times = np.array([r[0] for r in rows.select(f"_v{p + 1}").distinct().collect()])
    times.sort()
    scaled = rows.select(*[((F.col(f"_v{i}") - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0)).alias(f"_v{i}") for i in range(p)], f"_v{p}", f"_v{p + 1}")
    # each task of a round passes on sums of all times and regimes, so there are no more tasks than cores unless rows are many
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // SHARE))
    scaled = scaled.coalesce(tasks).sortWithinPartitions(f"_v{p + 1}").persist()
    rng = np.random.default_rng(seed)
    q, tiny = p + 2, 1e-10
    # a product of two columns stands once; whole: its place in the full matrix
    upper = np.triu_indices(q)
    whole = np.zeros((q, q), np.int64)
    whole[upper] = whole.T[upper] = np.arange(len(upper[0]))
    whole = whole.ravel()
    # of each K: gate, slopes, effects of times, variances
    now = {k: (rng.normal(0, 0.1, (k, p)), rng.normal(0, 0.1, (k, p)), np.zeros((k, len(times))), np.ones(k)) for k in range(2, most + 1)}
    last, done = dict.fromkeys(now, -math.inf), {}

    def sums(batches, now):
        total = {k: (np.zeros((len(times), k, q * q)), np.zeros(k * p + 1)) for k in now}
        for batch in batches:
            v = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(q)])
            if not len(v):
                continue
            v = v[np.argsort(v[:, -1], kind="stable")]
            heads = np.flatnonzero(np.append(True, v[1:, -1] != v[:-1, -1]))
            at = np.searchsorted(times, v[heads, -1])
            t = np.repeat(at, np.diff(np.append(heads, len(v))))
            a = v[:, :p].T.copy()
            z = np.column_stack([np.ones(len(v)), v[:, : p + 1]])
            zz = z[:, upper[0]] * z[:, upper[1]]
            shares = []
            for k, (gate, slopes, effects, variances) in now.items():
                # by regime and row, as sums and maxima over few regimes are quick that way
                share = gate @ a
                share = np.exp(share - share.max(0))
                share /= share.sum(0)
                e = v[:, p] - slopes @ a - effects[:, t]
                density = -0.5 * np.log(2 * np.pi * variances)[:, None] - 0.5 * e * e / variances[:, None]
                total[k][1][-1] += np.log((share * np.exp(density)).sum(0) + tiny).sum()
                r = np.log(share + tiny) + density
                r = np.exp(r - r.max(0))
                r /= r.sum(0)
                shares.append(r)
                total[k][1][:-1] += ((r * np.log(r + tiny)) @ a.T).ravel()
            # one product of matrices a time, for every K
            weighted = np.concatenate(shares)
            for i, (a0, a1) in enumerate(zip(heads.tolist(), [*heads[1:].tolist(), len(v)], strict=True)):
                half = weighted[:, a0:a1] @ zz[a0:a1]
                first = 0
                for k in now:
                    total[k][0][at[i]] += half[first : first + k][:, whole]
                    first += k
        flat = np.concatenate([part.ravel() for k in now for part in total[k]])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["at", "v"])

    for turn in range(rounds + 1):
        if not now:
            break
        size = sum(len(times) * k * q * q + k * p + 1 for k in now)  # (p + 2)^2 numbers a time and regime
        parts = scaled.mapInArrow(lambda batches, now=now: sums(batches, now), "at long, v double")
        summed = (parts if tasks * size <= GATHERED else parts.groupBy("at").agg(F.sum("v").alias("v"))).toArrow()
        got = np.bincount(summed.column("at").to_numpy(), summed.column("v").to_numpy(), size)
        following = {}
        for k, (gate, slopes, effects, variances) in now.items():
            m, rest, got = got[: len(times) * k * q * q].reshape(-1, k, q, q), got[len(times) * k * q * q :][: k * p + 1], got[len(times) * k * q * q + k * p + 1 :]
            ll, w = float(rest[-1]), m[:, :, 0, 0]
            if not math.isfinite(ll):
                continue
            # the first pass sees the starting values, whose likelihood counts for nothing
            if turn and abs(ll - last[k]) < tol or turn == rounds:
                done[k] = {"k": k, "bic": -2 * ll + (2 * k * p + k * len(times) + k) * math.log(n), "aic": -2 * ll + 2 * (2 * k * p + k * len(times) + k), "log_likelihood": ll, "converged": abs(ll - last[k]) < tol, "n_iterations": turn, "weights": (w.sum(0) / n).tolist(), "gate": gate.tolist(), "coefficients": slopes.tolist(), "time_effects": [dict(zip(times.tolist(), e, strict=True)) for e in effects.tolist()]}
                continue
            if turn:
                last[k] = ll
            if not (w.sum(0) > 0).all():
                continue
            small = 1e-6 * np.eye(p)
            gate = np.stack([np.linalg.solve(m[:, j, 1:-1, 1:-1].sum(0) + small, rest[j * p : (j + 1) * p]) for j in range(k)])
            each = np.linalg.solve(m[:, :, 1:-1, 1:-1] + small, m[:, :, 1:-1, -1:])[..., 0]  # time, regime, input
            slopes = (each * w[..., None]).sum(0) / (w.sum(0)[:, None] + tiny)
            effects = np.divide(m[:, :, 0, -1] - (m[:, :, 0, 1:-1] * each).sum(-1), w, out=np.zeros_like(w), where=w > 0).T
            c = np.concatenate([-effects.T[..., None], np.broadcast_to(-slopes, (len(times), k, p)), np.ones((len(times), k, 1))], -1)
            variances = np.maximum(np.einsum("tki,tkij,tkj->k", c, m, c) / w.sum(0), 1e-12)
            following[k] = gate, slopes, effects, variances
        now = following
    scaled.unpersist()
    if not done:
        raise ValueError("no K could be fitted")
    return min(done.values(), key=lambda f: f["bic"])


def anova(df: DataFrame, y: str, group: str, least: int = 3) -> DataFrame:
    """DG24, DG25: one row: n_groups, n, f, eta_squared over groups of least or more values (the tail of F: stats.f_sf)."""
    per = df.where(F.col(f"`{y}`").isNotNull()).groupBy(F.col(f"`{group}`")).agg(F.count("*").alias("n"), F.avg(_d(y)).alias("m"), (F.var_pop(_d(y)) * F.count("*")).alias("ssw")).where(F.col("n") >= least)
    t = per.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n"), F.sum("ssw").alias("ssw"), (F.sum(F.col("n") * F.col("m") ** 2) - F.sum(F.col("n") * F.col("m")) ** 2 / F.sum("n")).alias("ssb"))
    k, n = F.col("n_groups"), F.col("n")
    return t.where("n_groups >= 2").select("n_groups", "n", F.try_divide(F.col("ssb") / (k - 1), F.col("ssw") / (n - k)).alias("f"), F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")).alias("eta_squared"))


def stationarity(df: DataFrame, columns: list[str], entity: str, order: list[str], block: int = 100_000, by: str | None = None) -> DataFrame:
    """DG12: regime, column, n, statistic and p of an augmented Dickey-Fuller test on each entity-demeaned series, at ten or more values.

    A series runs through entities and, in each, through order, as these columns' types sort; each value of by has series of its own.
    All series are numbered at once, one after the other, and cut into blocks of so many values, each with the few values before
    it that its lags need; a block passes on one Gram matrix of all lags. Rows without an entity are a group of their own.
    """
    keys = list(dict.fromkeys([entity, *order]))
    regime = F.coalesce(F.col(f"`{by}`").cast("string"), F.lit("None")) if by else F.lit("all")
    known = [F.when(~F.isnan(_d(c)) & (F.abs(_d(c)) != float("inf")), _d(c)) for c in columns]
    wide = df.select(regime.alias("g"), *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], *[x.alias(f"v{i}") for i, x in enumerate(known)])
    means = wide.groupBy(F.col("g").alias("_g"), F.col("_k0").alias("_e")).agg(*[F.avg(f"v{i}").alias(f"_m{i}") for i in range(len(columns))])
    both = wide.join(means, (F.col("g") == F.col("_g")) & F.col("_k0").eqNullSafe(F.col("_e")))
    series = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), (F.col(f"v{i}") - F.col(f"_m{i}")).alias("v")) for i in range(len(columns))]))
    long = both.select("g", *[f"_k{i}" for i in range(len(keys))], series.alias("s")).select("g", "s.c", "s.v", *[f"_k{i}" for i in range(len(keys))]).where("v is not null")
    placed = numbered(long, ["g", "c", *[f"_k{i}" for i in range(len(keys))]], "at")
    # a row a regime and column
    seen = {(r["g"], r["c"]): r for r in placed.groupBy("g", "c").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.min("v").alias("low"), F.max("v").alias("high"), F.stddev_pop("v").alias("s")).collect()}
    use = {k: (r["n"], r["first"], r["s"] or 1.0, adf_lags(r["n"])) for k, r in seen.items() if r["n"] >= 10 and adf_lags(r["n"]) >= 0 and r["low"] != r["high"]}
    out = [(g, columns[c], r["n"], math.nan, math.nan) for (g, c), r in seen.items() if (g, c) not in use]
    if use:
        spark = df.sparkSession
        about = spark.createDataFrame([(g, c, *u) for (g, c), u in use.items()], "_g string, _c int, n long, first long, s double, most int")
        t = placed.join(F.broadcast(about), (F.col("g") == F.col("_g")) & (F.col("c") == F.col("_c"))).select("g", "c", (F.col("at") - F.col("first")).alias("t"), (F.col("v") / F.col("s")).alias("v"), "most")
        heads: dict[tuple, list] = {}
        for r in t.where(F.col("t") <= F.col("most") + 1).orderBy("g", "c", "t").collect():  # some tens of values a series
            heads.setdefault((r["g"], r["c"]), []).append(r["v"])
        cells = in_blocks(t, "t", block, max(u[3] for u in use.values()) + 1).groupBy("g", "c", "b").applyInPandas(_lag_sums(block), "g string, c int, at int, x double")
        cross = {k: np.zeros((u[3] + 3) ** 2) for k, u in use.items()}
        for r in cells.groupBy("g", "c", "at").agg(F.sum("x").alias("x")).toLocalIterator():  # (lags + 3)^2 numbers a series
            cross[r["g"], r["c"]][r["at"]] = r["x"]
        for (g, c), (n, _, _, most) in use.items():
            out.append((g, columns[c], n, *map(float, adf_of(cross[g, c].reshape(most + 3, most + 3), np.array(heads[g, c]), n))))
    return df.sparkSession.createDataFrame(sorted(out, key=lambda r: (r[0], columns.index(r[1]))), "regime string, column string, n long, statistic double, p double")


#: Numbers of lagged values that a task holds at once, however many lags a series of that length has.
LAGGED = 1_000_000


def _lag_sums(block: int):
    """Of a block of a series: the Gram matrix of adf_rows with the most lags, piece by piece."""

    def summed(key, pdf):
        import pandas as pd

        v = pdf.sort_values("t")
        most = int(v["most"].iloc[0])
        values, t0 = v["v"].to_numpy(), int(v["t"].iloc[0])
        end, step = t0 + len(values), max(1, LAGGED // (most + 3))
        total = np.zeros((most + 3, most + 3))
        for start in range(max(most + 1, int(key[2]) * block), end, step):
            low = max(start - most - 1 - t0, 0)
            m = adf_rows(values[low : min(start + step, end) - t0], t0 + low, most, start)
            total += m.T @ m
        return pd.DataFrame({"g": key[0], "c": np.int32(key[1]), "at": np.arange(total.size, dtype=np.int32), "x": total.ravel()})

    return summed


def shapiro_test(df: DataFrame, column: str, row_id: str, most: int = 5000) -> dict:
    """DG22: W and p of the first most values by a hash of row_id (the test is defined up to 5000)."""
    rows = df.where(F.col(f"`{column}`").isNotNull()).orderBy(F.xxhash64(row_id)).limit(most).select(_d(column).alias("v")).collect()
    w, p = shapiro(np.array([r["v"] for r in rows]))
    return {"n": len(rows), "w": w, "p": p}


def two_stage_kinetics(df: DataFrame, y: str, entity: str, time: str, least: int = 20) -> PanelFit | None:
    """MD12: the within fit on time alone, at least least complete rows."""
    rows = df.select(F.col(f"`{entity}`").alias(entity), _d(time).alias(time), _d(y).alias(y)).na.drop()
    return fixed_effects(rows, y, [time], entity) if rows.count() >= least else None


def two_stage_intercepts(df: DataFrame, y: str, entity: str, time: str, treatments: list[str], row_id: str) -> Fit | None:
    """MD14: each entity's intercept of y on time (two different times at least), fitted on the entity's first treatments; None of too few entities."""
    first = first_values(df, treatments, entity, row_id)
    line = df.where(_d(y).isNotNull() & _d(time).isNotNull()).groupBy(F.col(f"`{entity}`").alias("entity")).agg(F.count_distinct(_d(time)).alias("_n"), F.regr_intercept(_d(y), _d(time)).alias("intercept")).where("_n >= 2")
    frame = line.join(first, "entity").select("intercept", *[_d(c).alias(c) for c in treatments]).na.drop()
    if frame.count() <= len(treatments) + 2:
        return None
    return solve(gram(frame, ["intercept", *treatments]), "intercept", tuple(treatments))


FAMILIES = ("ols", "ridge", "fixed_effects", "random_effects", "lasso", "gradient_boosting")


def fit_family(df: DataFrame, family: str, y: str, x: list[str], entity: str | None = None, row_id: str | None = None) -> dict:
    """MD18: one model of a family as model_type, success, error_message, n, r_squared and coefficients (rounds.py fits whole rounds).

    An error: fewer complete rows than inputs and two more, families without the columns they need, and unknown ones. A fit that
    fails is an error with its message, never an exception.
    """
    out = {"model_type": family, "success": False, "error_message": None, "n": 0, "r_squared": 0.0, "coefficients": {}}
    try:
        if family not in FAMILIES:
            return out | {"error_message": f"unknown family {family}"}
        needs = {"fixed_effects": entity, "random_effects": entity, "lasso": row_id}
        if family in needs and needs[family] is None:
            return out | {"error_message": f"{family} needs {'a row_id' if family == 'lasso' else 'an entity'} column"}
        g = gram(df, [*x, y])
        n = int(round(complete(g, [*x, y])[0, 0]))
        few = {"error_message": f"{n} complete rows for {len(x)} inputs"}
        if n < len(x) + 3:
            return out | few
        if family == "fixed_effects":
            fe = fixed_effects(df, y, x, entity)
            return out | ({"success": True, "n": fe.n, "r_squared": fe.within_r2, "coefficients": fe.coefficients} if fe else few)
        if family == "random_effects":
            re = random_effects(df, y, x, entity)
            return out | ({"success": True, "n": re.n, "r_squared": re.r_squared, "coefficients": re.coefficients} if re else few)
        if family == "lasso":
            path = lasso_cv(df, y, x, row_id)
            return out | {"success": True, "n": n, "r_squared": path["cv_r2"], "coefficients": path["coefficients"]}
        if family == "gradient_boosting":
            t = tree_model(df, y, x)
            return out | {"success": True, "n": n, "r_squared": t["r_squared"], "coefficients": t["importances"]}
        f = solve(g, y, tuple(x), ridge=1.0 if family == "ridge" else 0.0)
        return out | ({"success": True, "n": f.n, "r_squared": f.r_squared, "coefficients": f.coefficients} if f else few)
    except Exception as e:  # noqa: BLE001  a model that cannot be fitted is a result
        return out | {"error_message": str(e)[:200]}
