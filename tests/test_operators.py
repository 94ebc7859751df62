import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaygrid.operators import clean, models, panel, profile, results, retrieval, screening


def gappy(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 5, 0.1, 2] + [0, 100, 3, 0]
    y = 1 + x @ [0.5, -0.2, 4, 0] + rng.normal(size=n) * 0.3
    rows = [(i, *[None if rng.random() < 0.1 else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, y double"), rows


def brute(rows, at):
    m = np.array([[r[j] if r[j] is not None else np.nan for j in (*at, 5)] for r in rows], float)
    m = m[~np.isnan(m).any(1)]
    x = np.column_stack([np.ones(len(m)), m[:, :-1]])
    b, *_ = np.linalg.lstsq(x, m[:, -1], rcond=None)
    e = m[:, -1] - x @ b
    return b, 1 - e @ e / ((m[:, -1] - m[:, -1].mean()) ** 2).sum(), len(m)


def test_gram_against_brute_force(spark):
    df, rows = gappy(spark)
    g = screening.gram(df, ["a", "b", "c", "d", "y"])
    place = {"a": 1, "b": 2, "c": 3, "d": 4}
    for c in screening.candidates(list(place), ["y"], sizes=(1, 2, 3)):
        fit = screening.solve(g, "y", c.x)
        b, r2, n = brute(rows, [place[v] for v in c.x])
        assert fit.n == n and fit.r_squared == pytest.approx(r2, abs=1e-9)
        assert list(fit.coefficients.values()) == pytest.approx(b.tolist(), rel=1e-7, abs=1e-8)


def test_screen_ranks_and_fills_quotas(spark):
    df, _ = gappy(spark)
    out = screening.screen(df, ["a", "b", "c"], ["y"], "row_id", time="d").collect()
    assert 0 < len(out) <= screening.TOP and [r["rank"] for r in out] == list(range(1, len(out) + 1))
    assert len({(r["y_col"], tuple(r["x_cols"])) for r in out}) == len(out)


def test_singular_constant_and_short(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i, 1.0, float(i % 3)) for i in range(30)], "row_id long, a double, b double, k double, y double")
    g = screening.gram(df, ["a", "b", "k", "y"])
    assert screening.solve(g, "y", ("a", "b")).rank == 1 and screening.correlated(g, ("a", "b"))
    assert screening.solve(g, "k", ("a",)) is None
    assert screening.solve(screening.gram(df.limit(4), ["a", "y"]), "y", ("a",)) is None
    assert screening.solve(screening.gram(df.where("a < 0"), ["a", "y"]), "y", ("a",)) is None


def test_fixed_effects_find_the_slope(spark):
    rng = np.random.default_rng(0)
    rows = [(e, float(t), float(3 * e + 2 * t + rng.normal() * 0.1)) for e in range(8) for t in range(6)]
    df = spark.createDataFrame(rows, "e int, t double, y double")
    fe = models.fixed_effects(df, "y", ["t"], "e")
    assert fe.coefficients["t"] == pytest.approx(2, abs=0.05) and fe.within_r2 > 0.99
    re = models.random_effects(df, "y", ["t"], "e")
    assert re.coefficients["t"] == pytest.approx(2, abs=0.05)
    assert models.fixed_effects(df.where("e < 2"), "y", ["t"], "e") is None


def test_penalized(spark):
    df, _ = gappy(spark)
    f = models.lasso_cv(df, "y", ["a", "b", "c", "d"], "row_id")
    assert f["cv_r2"] > 0.8 and abs(f["coefficients"]["d"]) < 0.1
    assert models.ridge_cv(df, "y", ["a", "b", "c", "d"], "row_id")["cv_r2"] > 0.8


def test_cleaning(spark):
    df = spark.createDataFrame([("1", "x", " - "), ("ND", None, "-"), (" 2.5 ", "b", "--"), ("1e3", "x", None)], "n string, s string, p string")
    out = clean.coerce_placeholders(df)
    assert [r["n"] for r in out.collect()] == [1.0, None, 2.5, 1000.0] and dict(out.dtypes)["p"] == "string"
    encoded, words = clean.label_encode(df, ["s"])
    assert sorted(str(r["s"]) for r in encoded.collect()) == ["0.0", "1.0", "1.0", "None"] and words.count() == 2
    odd = spark.createDataFrame([("1.5d",), ("inf",), ("1,000",)], "n string")
    assert clean.coerce_placeholders(odd).dtypes == [("n", "string")]
    assert clean.drop_empty(spark.createDataFrame([(1, None), (None, None)], "a int, b int")).columns == ["a"]


def test_profile_of_odd_tables(spark):
    empty = spark.createDataFrame([], "a double, b string")
    assert {r["name"]: r["n_unique"] for r in profile.profile(empty).collect()} == {"a": 0, "b": 0}
    nulls = spark.createDataFrame([(None, "x"), (None, "x")], "a double, b string")
    assert profile.profile(nulls).where("name = 'a'").first()["missing_pct"] == 100.0
    codes = {r["code"] for r in profile.validate(spark.createDataFrame([(1.0, 2.0)] * 3, "y double, x double"), "y", ["x"]).collect()}
    assert {"INSUFFICIENT_DATA", "OUTCOME_CONSTANT", "CONSTANT_INPUT"} <= codes


def test_panel_edges(spark):
    df = spark.createDataFrame([(1, 0.0, 4.0, 1.0), (1, 1.0, 2.0, 0.0), (1, 2.0, 1.0, 0.0), (2, 0.0, 0.0, 0.0)], "e int, t double, c double, d double")
    assert [r["entropy"] for r in panel.entropy(df, ["c", "d"]).orderBy("e", "t").collect()][1:] == [0.0, 0.0, 0.0]
    k = panel.rate_constants(df, "c", "e", "t", "t").collect()
    assert len(k) == 1 and k[0]["k"] == pytest.approx(math.log(2), abs=1e-6) and k[0]["half_life"] == 1.0
    assert panel.auc(df, "c", "e", "t").collect()[0]["auc"] == pytest.approx(4.5)
    ids = panel.derive_entity(df.withColumn("r", F.monotonically_increasing_id()), ["d"], "r").orderBy("r").collect()
    assert [r["_derived_entity_id"] for r in ids] == [0, 1, 1, 1]


def test_chunks():
    text = "One two. " * 400
    parts = list(retrieval.split_chunks(text, 100, 10))
    assert len(parts) > 1 and all(p.endswith(".") for _, p in parts) and max(len(p) for _, p in parts) <= 400
    assert list(retrieval.split_chunks("")) == [] and list(retrieval.split_chunks("x")) == [(0, "x")]


def test_topk_blocks_and_odd_vectors(spark, monkeypatch):
    rows = [(i, [float(i), 1.0]) for i in range(10)] + [(10, None), (11, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    q = df.withColumnRenamed("doc_id", "query_id")
    whole = sorted(map(tuple, retrieval.top_k(q, df, 3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, retrieval.top_k(q, df, 3).collect())) == whole and len(whole) == 30


def test_results_store(spark):
    old = spark.createDataFrame([("u", "h1", "id1"), ("u", "h2", "id2")], "user_sub string, content_hash string, id string")
    new = spark.createDataFrame([("u", "h2", "other")], "user_sub string, content_hash string, id string")
    out = {r["content_hash"]: r["id"] for r in results.upsert(old, new, ["user_sub", "content_hash"], keep=["id"]).collect()}
    assert out == {"h1": "id1", "h2": "id2"}
    m = spark.createDataFrame([({"a": math.nan, "b": 1.0},)], "m map<string,double>").select(results.json_safe(F.col("m"), 0.0).alias("m")).first()["m"]
    assert m == {"a": 0.0, "b": 1.0}
    for name, ddl in results.SCHEMAS.items():
        assert spark.createDataFrame([], ddl).count() == 0, name


def test_mixture_has_gate_time_effects_and_four_regimes(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1200):
        a, t, g = rng.normal(), i % 3, i % 4
        # a gate on a: the sign of a tells regimes 0, 1 from 2, 3
        a = abs(a) * (1 if g < 2 else -1)
        rows.append((float(a), float(t), float([3, -3, 3, -3][g] * a + [0, 8, 16, 24][g] + [0, 2, -2][t] * (g + 1) + rng.normal(0, 0.3))))
    df = spark.createDataFrame(rows, "a double, t double, y double").repartition(3)
    f = models.mixture(df, "y", ["a"], "t", most=4, rounds=15, seed=1)
    # the same rounds over all rows at once
    v = np.array(rows)
    z, t, y = (v[:, :1] - v[:, :1].mean()) / v[:, :1].std(), v[:, 1].astype(int), v[:, 2]
    rnd, fits = np.random.default_rng(1), []
    for k in (2, 3, 4):
        w, b, e, s = rnd.normal(0, 0.1, (k, 1)), rnd.normal(0, 0.1, (k, 1)), np.zeros((k, 3)), np.ones(k)
        last = -np.inf
        for _ in range(15):
            pi = np.exp(z @ w.T) / np.exp(z @ w.T).sum(1, keepdims=True)
            r = np.log(pi + 1e-10) - 0.5 * np.log(2 * np.pi * s) - 0.5 * (y[:, None] - z @ b.T - e.T[t]) ** 2 / s
            r = np.exp(r - r.max(1, keepdims=True))
            r /= r.sum(1, keepdims=True)
            for j in range(k):
                g = r[:, j]
                w[j] = (z[:, 0] * g * np.log(g + 1e-10)).sum() / ((z[:, 0] ** 2 * g).sum() + 1e-6)
                b[j] = 0
                for i in range(3):
                    at = t == i
                    bt = (z[at, 0] * g[at] * y[at]).sum() / ((z[at, 0] ** 2 * g[at]).sum() + 1e-6)
                    e[j, i] = np.average(y[at] - z[at, 0] * bt, weights=g[at])
                    b[j] += bt * g[at].sum() / (g.sum() + 1e-10)
                s[j] = np.average((y - z[:, 0] * b[j] - e[j, t]) ** 2, weights=g)
            pi = np.exp(z @ w.T) / np.exp(z @ w.T).sum(1, keepdims=True)
            ll = np.log((pi * np.exp(-0.5 * (y[:, None] - z @ b.T - e.T[t]) ** 2 / s) / np.sqrt(2 * np.pi * s)).sum(1) + 1e-10).sum()
            if abs(ll - last) < 1e-4:
                break
            last = ll
        fits.append((-2 * ll + (3 * k + 3 * k) * np.log(len(y)), k, ll, w.copy(), b.copy(), e.copy()))
    bic, k, ll, w, b, e = min(fits, key=lambda f: f[0])
    assert f["k"] == k and abs(f["bic"] - bic) < 1e-3 and abs(f["log_likelihood"] - ll) < 1e-3
    assert np.allclose(f["gate"], w, atol=1e-4) and np.allclose(f["coefficients"], b, atol=1e-4)
    assert np.allclose([[d[i] for i in range(3)] for d in f["time_effects"]], e, atol=1e-4)


def test_groups_that_differ_after_200_times(spark):
    rng = np.random.default_rng(4)
    # four groups that only differ at the last of 230 times
    rows = [(e, t, a, float(2 * a + (30 * (e % 4) if t >= 205 else 0) + rng.normal(0, 0.1))) for e in range(16) for t in range(230) for a in [float(rng.normal())] if (e + t) % 7]
    df = spark.createDataFrame(rows, "e long, t long, a double, y double")
    f = models.grouped_fixed_effects(df, "y", ["a"], "e", "t", most=4, rounds=4, starts=3)
    assert f["n_times"] == 230 and f["k"] == 4 and f["converged"]
    assert abs(f["coefficients"]["a"] - 2) < 0.01 and f["sse"] < 0.02 * len(rows)
    found = {r["entity"]: r["group"] for r in f["assignments"].collect()}
    assert len(found) == 16 and set(found.values()) == {1, 2, 3, 4} and all(found[e] == found[e % 4] for e in found)
    # least squares with a dummy for each group and time
    cells = sorted({(found[e], t) for e, t, _, _ in rows})
    at = {c: i for i, c in enumerate(cells)}
    design = np.zeros((len(rows), 1 + len(cells)))
    for i, (e, t, a, _) in enumerate(rows):
        design[i, 0], design[i, 1 + at[found[e], t]] = a, 1.0
    y = np.array([r[3] for r in rows])
    b, *_ = np.linalg.lstsq(design, y, rcond=None)
    sse, n = float(((y - design @ b) ** 2).sum()), len(rows)
    assert f["coefficients"]["a"] == pytest.approx(b[0], rel=1e-8) and f["sse"] == pytest.approx(sse, rel=1e-6)
    assert f["bic"] == pytest.approx(n * np.log(2 * np.pi * sse / n) + n + (1 + 4 * 230) * np.log(n), rel=1e-9)
    assert f["r_squared"] == pytest.approx(1 - sse / ((y - y.mean()) ** 2).sum(), rel=1e-9)
    effects = {(r["group"], r["time"]): r["effect"] for r in f["effects"].collect()}
    assert set(effects) == set(cells) and all(effects[c] == pytest.approx(b[1 + at[c]], abs=1e-8) for c in cells)


def test_candidates_are_scored_by_all_five_tests(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(50, 3, 500), rng.normal(size=500)
    # errors that spread with a, and a curve in b: no fit with a passes Breusch-Pagan, no fit with b RESET
    y = a + 2 * b + 1.5 * b**2 + rng.normal(size=500) * np.exp((a - 50) / 4)
    rows = [(i, float(p), float(q) if i % 9 else None, float(r)) for i, (p, q, r) in enumerate(zip(a, b, y, strict=True))]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, y double").repartition(3)
    g = screening.gram(df, ["a", "b", "y"])
    fits = [screening.solve(g, "y", x) for x in (("a",), ("b",), ("a", "b"))]
    for f, got in zip(fits, screening.auxiliary_batch(df, fits, g), strict=True):
        want = screening.auxiliary_tests(df, f)
        assert got["breusch_pagan_p"] == pytest.approx(want["breusch_pagan_p"], rel=1e-5, abs=1e-12)
        assert got["reset_p"] == pytest.approx(want["reset_p"], rel=1e-5, abs=1e-12)
    residual = screening.residual_tests(df, fits, "row_id")
    want = {}
    for f, t in zip(fits, residual, strict=True):
        aux = screening.auxiliary_tests(df, f)
        want[f.x] = screening.composite(aux["breusch_pagan_p"], t["durbin_watson"], f.max_vif, t["jarque_bera_p"], aux["reset_p"])
    out = {tuple(r["x_cols"]): r["diagnostic_score"] for r in screening.screen(df, ["a", "b"], ["y"], "row_id").collect()}
    assert out == {x: want[x] for x in out} and len(out) == 3
    old = {f.x: screening.composite(None, t["durbin_watson"], f.max_vif, t["jarque_bera_p"], None) for f, t in zip(fits, residual, strict=True)}
    assert out != old


def test_trees_fit_all_rows_whatever_their_layout(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2))
    rows = [(float(a), float(b), float(3 * (a > 0) + b + rng.normal(0, 0.2))) for a, b in x]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    one, many = (models.tree_model(d, "y", ["a", "b"], "gbt", maxIter=3, maxDepth=2, stepSize=1.0) for d in (df.coalesce(1), df.repartition(7, "b")))
    assert abs(one["cv_r2"] - many["cv_r2"]) < 1e-6 and abs(one["r_squared"] - many["r_squared"]) < 1e-6
    data = models._assembled(df, "y", ["a", "b"])
    got = np.array([(r["label"], r["prediction"]) for r in models.GBTRegressor(seed=42, maxIter=3, maxDepth=2, stepSize=1.0).fit(data).transform(data).collect()])
    y, e = got[:, 0], got[:, 0] - got[:, 1]
    assert len(y) == 300 and abs(one["r_squared"] - (1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-6
    assert one["gap"] == one["r_squared"] - one["cv_r2"]
