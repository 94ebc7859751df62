"""Numbers over a whole table, and what is built on row order, against plain numpy."""

import math

import numpy as np
import pytest

from assaygrid.functions import stats
from assaygrid.operators import clean, models, order, screening
from assaygrid.sources import tables


@pytest.mark.parametrize("ranges", [1, 2, 64])
def test_numbers_follow_the_order(spark, monkeypatch, ranges):
    monkeypatch.setattr(order, "RANGES", ranges)
    rng = np.random.default_rng(3)
    rows = [(int(a), None if b == 0 else f"k{b}") for a, b in rng.integers(0, 40, (500, 2))]
    df = spark.createDataFrame(rows, "a long, b string").repartition(5)
    got = sorted((r["n"], r["b"] or "", r["a"]) for r in order.numbered(df, ["b", "a"], "n").collect())
    assert [n for n, *_ in got] == list(range(500))
    assert [(b, a) for _, b, a in got] == sorted((b or "", a) for a, b in rows)
    assert order.numbered(df.where("a < 0"), ["a"], "n").count() == 0


def test_lines_keep_their_places(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"f{part}.csv").write_text("a,b\n" + "".join(f"{part * 10 + i}, x\n" for i in range(10)))
    got = tables.read_delimited(spark, str(tmp_path)).collect()
    assert sorted(int(r["row_id"]) for r in got) == list(range(30))
    by_file = {}
    for r in sorted(got, key=lambda r: int(r["row_id"])):
        by_file.setdefault(int(r["a"]) // 10, []).append(int(r["a"]))
    assert all(v == sorted(v) for v in by_file.values())


def plain_adf(y):
    """The lag by AIC on the common sample, then the fit on its own, by least squares."""
    most = stats.adf_lags(len(y))
    d = np.diff(y)

    def fit(lags, skip):
        x = np.column_stack([y[skip:-1], *[d[skip - k : len(d) - k] for k in range(1, lags + 1)], np.ones(len(d) - skip)])
        b, *_ = np.linalg.lstsq(x, d[skip:], rcond=None)
        e = d[skip:] - x @ b
        m = len(e)
        return b[0] / math.sqrt(e @ e / (m - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0]), m * (math.log(2 * math.pi * (e @ e) / m) + 1) + 2 * x.shape[1]

    best = min(range(most + 1), key=lambda k: (fit(k, most)[1], k))
    return fit(best, best)[0]


@pytest.mark.parametrize("block", [40, 100_000])
def test_stationarity_in_typed_order(spark, block):
    """Entities 1, 2 and 10 and days beyond 100: as text they would be shuffled."""
    rng = np.random.default_rng(5)
    rows, walk, still = [], {}, {}
    for e in (1, 2, 10):
        walk[e], still[e] = np.cumsum(rng.normal(size=60)), np.zeros(60)
        for i in range(1, 60):
            still[e][i] = 0.3 * still[e][i - 1] + rng.normal()
        rows += [(e, 3 * i, float(walk[e][i]), float(still[e][i]), 1.0) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "e double, day double, walk double, still double, flat double").repartition(4)
    got = {r["column"]: r for r in models.stationarity(df, ["walk", "still", "flat"], "e", ["day"], block).collect()}
    for name, parts in (("walk", walk), ("still", still)):
        series = np.concatenate([parts[e] - parts[e].mean() for e in (1, 2, 10)])
        assert got[name]["n"] == 180 and got[name]["statistic"] == pytest.approx(plain_adf(series), rel=1e-6)
    assert got["walk"]["p"] > 0.05 > got["still"]["p"] and math.isnan(got["flat"]["p"])


def test_diagnostics_of_residuals(spark):
    rng = np.random.default_rng(8)
    n = 400
    x = rng.normal(size=(n, 2)) * [3, 1] + [10, 0]
    e = np.zeros(n)
    for i in range(1, n):
        e[i] = 0.4 * e[i - 1] + rng.normal() * (1 + abs(x[i, 1]))
    y = 2 + x @ [0.5, -1] + e
    rows = [(int(i), float(a), float(b), float(c)) for i, (a, b), c in zip(range(n), x, y, strict=True)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(r[0]), *map(float, r[1:])) for r in rows], "id long, a double, b double, y double").repartition(5)
    g = screening.gram(df, ["a", "b", "y"])
    fit = screening.solve(g, "y", ("a", "b"))
    z = np.column_stack([np.ones(n), x])
    b, *_ = np.linalg.lstsq(z, y, rcond=None)
    u = y - z @ b
    t = screening.residual_tests(df, [fit], "id")[0]
    assert t["durbin_watson"] == pytest.approx(float((np.diff(u) ** 2).sum() / (u @ u)))
    assert t["skew"] == pytest.approx(float(((u - u.mean()) ** 3).mean() / u.std() ** 3), abs=1e-9) and t["kurt"] == pytest.approx(float(((u - u.mean()) ** 4).mean() / u.var() ** 2 - 3), abs=1e-8)
    assert t["bp_lite_r2"] == pytest.approx(float(np.corrcoef(u**2, z @ b)[0, 1] ** 2)) and t["y_std"] == pytest.approx(float(y.std(ddof=1)))

    def r2(target, columns):
        w = np.column_stack([np.ones(n), *columns])
        c, *_ = np.linalg.lstsq(w, target, rcond=None)
        return 1 - ((target - w @ c) ** 2).sum() / ((target - target.mean()) ** 2).sum()

    lags = [np.append(0.0, u[:-1]), np.append([0.0, 0.0], u[:-2])]
    for block in (50, 100_000):
        assert screening.serial_correlation(df, fit, "id", block) == pytest.approx(stats.chi2_sf(n * r2(u, [*x.T, *lags]), 2), rel=1e-6)
    squares = [x[:, 0] ** 2, x[:, 0] * x[:, 1], x[:, 1] ** 2]
    assert screening.heteroscedasticity(df, fit) == pytest.approx(stats.chi2_sf(n * r2(u**2, [*x.T, *squares]), 5), rel=1e-5)
    h = np.einsum("ij,jk,ik->i", z, np.linalg.inv(z.T @ z), z)
    s2 = (u @ u - u**2 / (1 - h)) / (n - 4)
    d = screening.influence(df, fit)
    assert d["n_high_leverage"] == int((h > 4 / n).sum()) and d["max_studentized"] == pytest.approx(float(np.abs(u / np.sqrt(s2 * (1 - h))).max()))
    assert screening.standardized(g, fit) == pytest.approx({"a": b[1] * x[:, 0].std() / y.std(), "b": b[2] * x[:, 1].std() / y.std()})


def test_more_than_62_variables(spark):
    """Patterns of missing values are kept at any number of variables."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 70))
    v[:30, 69] = np.nan
    rows = [tuple(None if math.isnan(c) else float(c) for c in r) for r in v]
    names = [f"v{i}" for i in range(70)]
    g = screening.gram(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)), names)
    assert screening.complete(g, ["v0", "v69"])[0, 0] == 30 and screening.complete(g, ["v0", "v68"])[0, 0] == 60


def test_codes_and_steps(spark):
    df = spark.createDataFrame([(3, "b"), (1, "c"), (2, None), (5, "b"), (4, "a")], "id long, v string")
    assert {r["id"]: r["v_code"] for r in clean.factorize(df, "v", "id").collect()} == {1: 0.0, 2: None, 3: 1.0, 4: 2.0, 5: 1.0}
    assert [(r["class"], r["code"]) for r in clean.label_dictionary(df, "v").orderBy("code").collect()] == [("a", 0.0), ("b", 1.0), ("c", 2.0)]
    audit = clean.Steps(df).then("outcome", clean.drop_missing_outcome, "v").audit().orderBy("step").collect()
    assert [(r["name"], r["n_rows"]) for r in audit] == [("read", 5), ("outcome", 4)]


def test_models_that_fail_are_results(spark):
    df = spark.createDataFrame([(float(i), float(i % 7), i % 4) for i in range(40)], "y double, x double, e long")
    assert models.fit_family(df, "fixed_effects", "y", ["x"], entity="e")["success"] and models.fit_family(df, "random_effects", "y", ["x"], entity="e")["model_type"] == "random_effects"
    assert models.fit_family(df.limit(2), "ols", "y", ["x"])["error_message"] and not models.fit_family(df, "ols", "y", ["absent"])["success"]
