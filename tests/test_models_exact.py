"""Panel effects, penalized paths and rates against plain numpy, written out."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaygrid.functions.stats import chi2_sf
from assaygrid.operators import models, panel
from assaygrid.operators.screening import gram


@pytest.fixture(scope="module")
def uneven(spark):
    rng = np.random.default_rng(8)
    rows = []
    for e in range(25):
        level, shift = rng.normal() * 2, rng.normal()
        for t in range(int(rng.integers(3, 9))):
            a, b = rng.normal() + shift, rng.normal()
            rows.append((e, float(a), float(b), float(1.5 * a - 0.7 * b + level + rng.normal() * 0.4)))
    rows += [(25, None, 1.0, 2.0), (26, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, "e long, a double, b double, y double").repartition(3), [r for r in rows if None not in r]


def test_random_effects_and_hausman(uneven):
    df, rows = uneven
    e = np.array([r[0] for r in rows])
    x, y = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    names = np.unique(e)
    at = np.searchsorted(names, e)
    size = np.bincount(at)
    mean = lambda v: np.bincount(at, v) / size
    within = lambda v: v - mean(v)[at]
    xw, yw = np.column_stack([within(c) for c in x.T]), within(y)
    b_fe = np.linalg.solve(xw.T @ xw, xw.T @ yw)
    r = yw - xw @ b_fe
    s2e = r @ r / (len(y) - len(names) - 2)
    cov_fe = s2e * np.linalg.inv(xw.T @ xw)
    xb = np.column_stack([np.ones(len(names)), *[mean(c) for c in x.T]])
    bb, *_ = np.linalg.lstsq(xb, mean(y), rcond=None)
    rb = mean(y) - xb @ bb
    s2u = max(0.0, rb @ rb / (len(names) - 3) - s2e * (1 / size).mean())
    theta = (1 - np.sqrt(s2e / (size * s2u + s2e)))[at]
    xq = np.column_stack([1 - theta, *[c - theta * mean(c)[at] for c in x.T]])
    yq = y - theta * mean(y)[at]
    b_re = np.linalg.solve(xq.T @ xq, xq.T @ yq)
    rq = yq - xq @ b_re
    cov_re = rq @ rq / (len(y) - 3) * np.linalg.inv(xq.T @ xq)

    fe = models.fixed_effects(df, "y", ["a", "b"], "e", least_within=0.0)
    re = models.random_effects(df, "y", ["a", "b"], "e")
    assert [fe.coefficients[c] for c in ("a", "b")] == pytest.approx(b_fe.tolist(), rel=1e-8)
    assert [re.coefficients[c] for c in ("const", "a", "b")] == pytest.approx(b_re.tolist(), rel=1e-7)
    assert [re.errors[c] for c in ("const", "a", "b")] == pytest.approx(np.sqrt(np.diag(cov_re)).tolist(), rel=1e-7)
    d = b_fe - b_re[1:]
    want = float(d @ np.linalg.inv(cov_fe - cov_re[1:, 1:]) @ d)
    found = models.hausman(fe, re)
    assert found is None if want < 0 else found == pytest.approx((want, chi2_sf(want, 2)), rel=1e-5)


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 4)) * [1, 8, 0.2, 3] + [0, 50, 1, -2]
    x[:, 3] += x[:, 0] * 2
    y = 2 + x @ [0.9, -0.1, 3.0, 0.0] + rng.normal(size=300)
    rows = [(i, *[float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows + [(300, None, 1.0, 1.0, 1.0, 1.0)], "row_id long, a double, b double, c double, d double, y double").repartition(4)
    fold = {r["row_id"]: r["f"] for r in df.select("row_id", F.pmod(F.xxhash64("row_id"), F.lit(5)).alias("f")).collect()}
    return df, x, y, np.array([fold[i] for i in range(300)])


def descent(x, y, alpha, l1):
    """Least 1/2n |y - xb|^2 + alpha (l1 |b|_1 + (1 - l1)/2 |b|^2), one coordinate after the other, on the rows."""
    b, n = np.zeros(x.shape[1]), len(y)
    for _ in range(5000):
        old = b.copy()
        for j in range(len(b)):
            z = x[:, j] @ (y - x @ b + x[:, j] * b[j]) / n
            b[j] = math.copysign(max(abs(z) - alpha * l1, 0), z) / (x[:, j] @ x[:, j] / n + alpha * (1 - l1))
        if np.abs(b - old).max() < 1e-12:
            break
    return b


def scaled(v):
    return (v - v.mean(0)) / v.std(0)


@pytest.mark.parametrize("l1", [1.0, 0.5])
def test_lasso_path(wide, l1):
    df, x, y, fold = wide
    f = models.lasso_cv(df, "y", ["a", "b", "c", "d"], "row_id", l1=l1, path=20)
    top = np.abs(scaled(x).T @ scaled(y) / len(y)).max() / l1
    alphas, errors = top * np.logspace(0, -3, 20), np.zeros(20)
    for k in range(5):
        mine, rest = fold == k, fold != k
        for i, a in enumerate(alphas):
            b = descent(scaled(x[rest]), scaled(y[rest]), a, l1) * y[rest].std() / x[rest].std(0)
            errors[i] += ((y[mine] - y[rest].mean() - (x[mine] - x[rest].mean(0)) @ b) ** 2).sum()
    best = int(np.argmin(errors))
    assert f["alpha"] == pytest.approx(alphas[best], rel=1e-9) and f["n"] == 300
    b = descent(scaled(x), scaled(y), alphas[best], l1)
    assert list(f["coefficients"].values()) == pytest.approx(b.tolist(), abs=1e-7)
    assert f["nonzero"] == (np.abs(b) > 0.01).sum() and f["sparsity"] == 1 - f["nonzero"] / 4
    assert f["cv_r2"] == pytest.approx(1 - errors[best] / ((y - y.mean()) ** 2).sum(), rel=1e-8)


def test_ridge_path(wide):
    df, x, y, fold = wide
    f = models.ridge_cv(df, "y", ["a", "b", "c", "d"], "row_id")

    def fit(rows, alpha, scale):
        xc = (x[rows] - x[rows].mean(0)) / scale
        return np.linalg.solve(xc.T @ xc + alpha * np.eye(4), xc.T @ (y[rows] - y[rows].mean())) / scale

    every = np.ones(300, bool)
    g = gram(df.na.drop(), ["a", "b", "c", "d", "y"])
    scale = np.array([g.scale[g.variables.index(c)] for c in "abcd"])  # penalties count in these units
    alphas, errors = np.logspace(-3, 4, 50), np.zeros(50)
    for k in range(5):
        mine, rest = fold == k, fold != k
        for i, a in enumerate(alphas):
            errors[i] += ((y[mine] - y[rest].mean() - (x[mine] - x[rest].mean(0)) @ fit(rest, a, scale)) ** 2).sum()
    best = int(np.argmin(errors))
    assert f["alpha"] == pytest.approx(alphas[best])
    v = np.linalg.svd((x - x.mean(0)) / scale, compute_uv=False) ** 2
    assert f["effective_df"] == pytest.approx((v / (v + alphas[best])).sum(), rel=1e-8)
    assert f["condition"] == pytest.approx(math.sqrt(v.max() / v.min()), rel=1e-8)
    b, ols = fit(every, alphas[best], scale) * scale, fit(every, 0.0, scale) * scale
    assert f["shrinkage"] == pytest.approx(1 - np.linalg.norm(b) / np.linalg.norm(ols), abs=1e-8)
    assert f["cv_r2"] == pytest.approx(1 - errors[best] / ((y - y.mean()) ** 2).sum(), rel=1e-8)


def test_elastic_net(wide):
    df, x, y, _ = wide
    f = models.elastic_net(df, "y", ["a", "b", "c", "d"], alpha=0.3, l1=0.5)
    # inputs and outcome in population deviations; the penalty in units of the outcome's
    sx, sy = x.std(0), y.std()
    b = descent((x - x.mean(0)) / sx, (y - y.mean()) / sy, 0.3 / sy, 0.5) * sy / sx
    assert list(f["coefficients"].values()) == pytest.approx(b.tolist(), abs=1e-5)
    assert f["intercept"] == pytest.approx(y.mean() - x.mean(0) @ b, abs=1e-3)
    e = y - y.mean() - (x - x.mean(0)) @ b
    assert f["r_squared"] == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum(), abs=1e-6)


def test_rates_by_closed_forms(spark):
    rows = [("p", t, c) for t, c in ((0.0, 8.0), (1.0, 5.0), (2.0, 2.0))] + [("up", float(t), 1.0 + t) for t in range(4)] + [(None, float(t), 4.0 - t) for t in range(3)]
    rows += [("zero", float(t), 0.0) for t in range(3)] + [("gone", 0.0, 5.0), ("gone", 1.0, 0.0), ("gone", 2.0, 0.0)] + [("exact", float(t), 2.0**-t) for t in range(4)]
    df = spark.createDataFrame(rows, "e string, t double, c double").repartition(5)
    found = {r["entity"]: r for r in panel.rate_constants(df, "c", "e", "t", "t").collect()}
    assert set(found) == {"p", "gone", "exact"}
    log = np.log(np.array([8.0, 5.0, 2.0]) / 8)
    slope = (log[2] - log[0]) / 2
    e = log - log.mean() - slope * np.array([-1.0, 0.0, 1.0])
    se = math.sqrt(e @ e / 2)
    # with one degree of freedom the distribution of t is Cauchy's
    assert found["p"]["k"] == round(-slope, 6) and found["p"]["se"] == round(se, 6)
    assert found["p"]["p_value"] == pytest.approx(1 - 2 / math.pi * math.atan(-slope / se), abs=1e-6)
    assert found["exact"]["p_value"] == 0.0 and found["exact"]["half_life"] == 1.0
    assert found["gone"]["k"] == pytest.approx(-math.log(1e-12) / 2, abs=1e-6)


def test_divergence_begins_with_the_first_row(spark):
    rows = [("a", 1.0, 0, 1.0, 1.0), ("a", 0.0, 1, 3.0, 1.0), ("a", 0.0, 2, 1.0, 3.0), (None, 0.0, 3, 1.0, 2.0), ("b", 0.0, 4, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "e string, t double, i long, c1 double, c2 double").repartition(3)
    found = {r["i"]: r["kl"] for r in panel.kl_from_initial(df, ["c1", "c2"], "e", "t", "i").collect()}
    kl = lambda p, q: sum(a * math.log(a / b) for a, b in zip(p, q, strict=True))
    assert len(found) == 5 and found[1] == pytest.approx(0, abs=1e-9) and found[3] == 0 and found[4] == pytest.approx(0, abs=1e-9)
    assert found[0] == pytest.approx(kl((0.5, 0.5), (0.75, 0.25)), abs=1e-9) and found[2] == pytest.approx(kl((0.25, 0.75), (0.75, 0.25)), abs=1e-9)


def test_modelable_outputs(spark):
    rows = [(float(i), 1.0 if i < 2 else 0.0, 0.0, None if i % 2 else 1.0, 5.0) for i in range(20)]
    df = spark.createDataFrame(rows, "y double, c1 double, c2 double, c3 double, flat double")
    names = lambda *a, **k: {r["name"]: r for r in panel.modelable_outputs(df, *a, **k).collect()}
    full = names("y", ["c1", "c2", "c3"], "c1", "t", True)
    assert set(full) == {"y", "total_composition_concentration", "shannon_entropy", "kl_divergence", "degradation_rate_k"}
    total = np.array([(r[1] + r[2] + (r[3] or 0.0)) for r in rows])
    got = full["total_composition_concentration"]
    assert got["n_nonzero"] == (total > 0).sum() and got["variance"] == pytest.approx(total.var(ddof=1)) and got["approach"] == "panel_regression"
    assert full["degradation_rate_k"]["sources"] == ["c1", "t"] and full["kl_divergence"]["variance"] == 1.0
    assert set(names("flat", ["c1", "c2"])) == set() and set(names("absent", [])) == set()
    # two of twenty are above zero: not more than a tenth
    assert set(names("c1", [])) == set() and names("y", [])["y"]["approach"] == "cross_sectional"
    empty = panel.modelable_outputs(df.limit(0), "y", ["c1", "c2", "c3"]).collect()
    assert [r["name"] for r in empty] == ["shannon_entropy"]


def test_half_lives_do_not_hang_on_the_order_of_rows(spark):
    # halves and wholes: the exact half-life of these days is 3319.875
    low = {2, 3, 7, 11, 13, 14, 17, 21, 22, 23, 25, 29}
    days = [d for d in range(30) if d not in (16, 20)]
    rng = np.random.default_rng(3)
    rows = [(e, 24.0 * d, 1.0 if d in low else 2.0) for e in range(60) for d in rng.permutation(days).tolist()]
    df = spark.createDataFrame(rows, "e long, t double, c double").repartition(7)
    found = panel.rate_constants(df, "c", "e", "t", "t").collect()
    assert len(found) == 60 and {(r["n"], r["half_life"]) for r in found} == {(28, 3319.88)}


def test_groups_are_fitted_from_one_pass_over_rows(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(e, t, float(a), float(2 * a + 10 * (e % 3) * t + rng.normal(0, 0.1))) for e in range(30) for t in range(4) for a in rng.normal(size=3)]
    df = spark.createDataFrame(rows, "e long, t long, a double, y double")
    grams = []
    monkeypatch.setattr(models, "gram", lambda *given: grams.append(1) or gram(*given))
    f = models.grouped_fixed_effects(df, "y", ["a"], "e", "t", most=4, starts=4)
    # turns of all K work on sums by entity and time
    assert len(grams) == 1 and f["k"] == 3 and f["converged"] and abs(f["coefficients"]["a"] - 2) < 0.02
    group = {r["entity"]: r["group"] for r in f["assignments"].collect()}
    assert all(group[e] == group[e % 3] for e in group) and len(set(group.values())) == 3
    y, a = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
    cell = np.array([group[r[0]] * 10 + r[1] for r in rows])
    mean = lambda v: np.array([v[cell == c].mean() for c in cell])
    b = (a - mean(a)) @ (y - mean(y)) / ((a - mean(a)) @ (a - mean(a)))
    assert f["sse"] == pytest.approx(((y - mean(y) - b * (a - mean(a))) ** 2).sum(), rel=1e-9)
    assert {(r["group"] * 10 + r["time"], round(r["effect"], 9)) for r in f["effects"].collect()} == set(zip(cell.tolist(), np.round(mean(y) - b * mean(a), 9).tolist(), strict=True))


def test_rounds_of_a_mixture_take_as_many_tasks_as_cores(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(float(i % 3), float(a), float(b), float((2.0 if i % 2 else -2.0) * a + b + 0.1 * c)) for i, (a, b, c) in enumerate(rng.normal(size=(240, 3)))]
    df = spark.createDataFrame(rows, "t double, a double, b double, y double").repartition(40)
    seen, plain = [], type(df).persist
    monkeypatch.setattr(type(df), "persist", lambda self, *level: seen.append(self.rdd.getNumPartitions()) or plain(self, *level))
    straight = models.mixture(df, "y", ["a", "b"], "t", most=2, rounds=5)
    assert seen == [spark.sparkContext.defaultParallelism]
    monkeypatch.setattr(models, "GATHERED", 0)
    shuffled = models.mixture(df, "y", ["a", "b"], "t", most=2, rounds=5)
    assert abs(straight["log_likelihood"] - shuffled["log_likelihood"]) < 1e-6 and straight["n_iterations"] == shuffled["n_iterations"]


def test_rates_of_level_and_halving_series_as_in_sql(spark):
    # few small whole numbers: slopes that are zero but for rounding, and half-lives on ties
    import duckdb
    import pandas as pd

    rng = np.random.default_rng(12)
    rows = [(e, 24.0 * float(d), float(rng.integers(1, 4))) for e in range(3000) for d in rng.choice(30, int(rng.integers(3, 9)), replace=False)]
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.register("given", pd.DataFrame(rows, columns=["e", "t", "c"]))
    sql = """WITH r AS (SELECT e, t, c, first(c) OVER (PARTITION BY e ORDER BY t) AS c0 FROM given),
    f AS (SELECT e, count(*) AS n, regr_slope(ln(c / c0), t) AS b, regr_r2(ln(c / c0), t) AS r2, regr_sxx(ln(c / c0), t) AS sxx, regr_syy(ln(c / c0), t) AS syy FROM r GROUP BY 1)
    SELECT e, n, round(-b, 6) + 0.0, round(ln(2) / -b, 2) + 0.0, round(sqrt(greatest(0, (1 - r2) * syy / ((n - 2) * sxx))), 6) + 0.0 FROM f WHERE n >= 3 AND sxx > 0 AND b < 0 ORDER BY e"""
    df = spark.createDataFrame(rows, "e long, t double, c double").repartition(5, "c", "t")
    found = panel.rate_constants(df, "c", "e", "t", "t").select("entity", "n", "k", "half_life", "se").orderBy("entity").collect()
    assert [tuple(r) for r in found] == con.execute(sql).fetchall()
