"""The panel half of the screening, all candidates and regimes at once, against each one by itself."""

import numpy as np
import pytest

from assaygrid.operators import models, screening, within


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    rows = []
    for e in range(24):
        level = rng.normal(0, 3)
        walk = np.cumsum(rng.normal(size=14))
        for t in range(14):
            a, b, k = rng.normal(), walk[t], float(e % 5)
            y = level + 1.5 * a - 0.7 * b + 0.2 * t + rng.normal(0, 0.5)
            rows.append((e * 100 + t, "r" if e % 3 else None, e if e != 7 else None, float(t), float(a) if (e + t) % 6 else None, float(b) if t % 7 else float("nan"), k, float(y) if (e * t) % 11 != 1 else None))
    return spark.createDataFrame(rows, "row_id long, regime string, e int, t double, a double, b double, k double, y double").repartition(5)


def demeaned_fit(df, y, x, entity):
    """By plain least squares on demeaned rows: coefficients, clustered errors, within, between and overall R2, absolute parts."""
    frame = df.toPandas()
    frame = frame[np.isfinite(frame[[*x, y]].astype(float)).all(axis=1) & frame[entity].notna()]
    means = frame.groupby(entity)[[*x, y]].transform("mean")
    d = frame[[*x, y]] - means
    xd, yd = d[x].to_numpy(), d[y].to_numpy()
    inv = np.linalg.inv(xd.T @ xd)
    b = inv @ xd.T @ yd
    e = yd - xd @ b
    groups = frame[entity].to_numpy()
    scores = np.array([xd[groups == g].T @ e[groups == g] for g in np.unique(groups)])
    g = len(scores)
    se = np.sqrt(np.diag(inv @ scores.T @ scores @ inv * g / (g - 1)))
    raw = frame[y] - frame[y].mean() - (frame[x] - frame[x].mean()).to_numpy() @ b
    per = frame.groupby(entity)[[*x, y]].mean()
    off = per[y] - frame[y].mean() - (per[x] - frame[x].mean()).to_numpy() @ b
    sizes = frame.groupby(entity).size()
    return b, se, 1 - e @ e / (yd @ yd), 1 - (off**2).sum() / ((per[y] - per[y].mean()) ** 2).sum(), 1 - (raw**2).sum() / ((frame[y] - frame[y].mean()) ** 2).sum(), np.sqrt(e @ e / len(e)), sizes.min(), sizes.max(), g


@pytest.mark.parametrize("x", [["t"], ["a", "t"], ["b", "a", "t"]])
def test_within_fits_as_each_alone(panel, x):
    m = within.entity_moments(panel, ["t", "a", "b", "k", "y"], "e", "regime")
    specs = [(g, "y", [*x, "k"]) for g in ("r", "None")] + [("nobody", "y", x), ("r", "y", ["k"])]
    found = within.within_fits(m, specs, always=("t",))
    assert sorted(found) == [0, 1]  # no rows; nothing that varies within
    for i, where in ((0, "regime = 'r'"), (1, "regime is null")):
        f = found[i]
        b, se, inside, between, overall, rmse, least, most, groups = demeaned_fit(panel.where(where), "y", x, "e")
        assert f.x == x and f.n_entities == groups and (f.least_obs, f.most_obs) == (least, most) and f.balanced == (least == most)
        assert [f.coefficients[c] for c in x] == pytest.approx(b, rel=1e-8)
        assert [f.clustered_se[c] for c in x] == pytest.approx(se, rel=1e-8)
        assert (f.within_r2, f.between_r2, f.overall_r2, f.rmse) == pytest.approx((inside, between, overall, rmse), rel=1e-8)
        one = models.fixed_effects(panel.where(where), "y", x, "e", least_within=0.0)
        assert f.f_p == pytest.approx(one.f_p, abs=1e-12) and f.coefficients == pytest.approx(one.coefficients, rel=1e-8)


def test_absorbed_inputs_are_left_out(spark):
    rows = [(e, float(t), float(2 * t + e), float(e + 3 * t + (t % 2))) for e in range(5) for t in range(6)]
    df = spark.createDataFrame(rows, "e int, t double, twice double, y double")
    m = within.entity_moments(df, ["t", "twice", "y"], "e")
    assert within.within_fits(m, [("all", "y", ["t", "twice"])], always=("t",))[0].x == ["t"]
    empty = within.entity_moments(df.where("e > 9"), ["t", "y"], "e")
    assert within.within_fits(empty, [("all", "y", ["t"])]) == {}


def test_soundness_of_every_regime(panel):
    parts = within.panel_parts(panel, ["a", "b", "k"], ["y"], "e", ["t"], "regime", ("t",))
    assert set(parts) == {"r", "None"}
    for g, where in (("r", "regime = 'r'"), ("None", "regime is null")):
        frame = panel.where(where).toPandas()
        y = frame["y"].astype(float)
        assert parts[g].icc["y"] == pytest.approx(y.groupby(frame["e"]).transform("mean").var() / y.var(), abs=1e-4)
        assert parts[g].within == ["a", "b"]
        alone = {r["column"]: r["p"] for r in models.stationarity(panel.where(where), ["t", "a", "b"], "e", ["t"]).collect()}
        assert {c: None if np.isnan(p) else p < 0.05 for c, p in alone.items()} == {c: parts[g].stationary[c] for c in alone}


def test_screening_with_panels_as_each_candidate(panel):
    out = screening.screen(panel, ["a", "b", "k"], ["y"], "row_id", time="t", regime="regime", entity="e").collect()
    assert {r["model_type"] for r in out} == {"screening_linear", "panel_fixed_effects"}
    assert {r["regime"] for r in out} == {"r", "None"}
    for g, where in (("r", "regime = 'r'"), ("None", "regime is null")):
        part = panel.where(where)
        parts = within.panel_parts(part, ["a", "b", "k"], ["y"], "e", ["t"], None, ("t",))["all"]
        matrix = screening.gram(part, ["a", "b", "k", "t", "y"])
        for r in (r for r in out if r["regime"] == g):
            x = tuple(r["x_cols"])
            if r["model_type"] == "panel_fixed_effects":
                fe = models.fixed_effects(part, "y", list(x), "e", least_within=0.0)
                want = screening.panel_composite(parts.adf_fraction(["t", *x]), parts.icc["y"], fe.within_r2, round(fe.f_p, 6), fe.n_entities)
                assert r["diagnostic_score"] == want and r["score"] == pytest.approx(fe.within_r2 * want, abs=1e-6) and x == ("t", "a", "b")
                continue
            fit = screening.solve(matrix, "y", x)
            t, a = screening.residual_tests(part, [fit], "row_id")[0], screening.auxiliary_tests(part, fit)
            ols = screening.composite(a["breusch_pagan_p"], t["durbin_watson"], fit.max_vif, t["jarque_bera_p"], a["reset_p"])
            inside = [c for c in x if c in parts.within]
            both = screening.panel_composite(parts.adf_fraction(inside), parts.icc["y"], None, None, None) if inside else None
            assert r["diagnostic_score"] == screening.effective(ols, both) and r["panel_score"] == both
            assert r["score"] == pytest.approx(fit.r_squared * r["diagnostic_score"], abs=1e-6)


def test_regimes_share_a_pass_and_keep_their_results(panel):
    """Residual tests of regimes together are those of each by itself; keys that are text sort as text."""
    g = screening.gram(panel, ["a", "t", "y"], ["regime"])
    keyed = panel.selectExpr("*", "lpad(cast(row_id as string), 9, '0') as name")
    fits = [screening.solve(g, "y", ("a", "t"), (k,)) for k in ("r", "None")]
    together = screening.residual_tests(keyed, fits, "name", "regime", ["r", "None"])
    for f, where, got in zip(fits, ("regime = 'r'", "regime is null"), together, strict=True):
        alone = screening.residual_tests(panel.where(where), [f], "row_id")[0]
        numbers = lambda d: {k: v for k, v in d.items() if k not in ("fit", "x_cols", "y_col")}
        assert numbers(got) == pytest.approx(numbers(alone), rel=1e-9)


def test_lags_of_a_block_are_summed_in_pieces(monkeypatch):
    import pandas as pd

    from assaygrid.functions.stats import adf_rows
    from assaygrid.operators import models

    v = np.random.default_rng(5).normal(size=700).cumsum()
    whole = adf_rows(v, 0, 9, 10)
    widest = []
    monkeypatch.setattr(models, "LAGGED", 1200)
    monkeypatch.setattr(models, "adf_rows", lambda *given: widest.append(adf_rows(*given)) or widest[-1])
    total = np.zeros(144)
    for b in range(3):
        low = max(b * 300 - 10, 0)
        pdf = pd.DataFrame({"t": np.arange(low, min((b + 1) * 300, 700)), "most": 9})
        pdf["v"] = v[pdf["t"]]
        total += models._lag_sums(300)(("all", 0, b), pdf)["x"].to_numpy()
    assert total == pytest.approx((whole.T @ whole).ravel()) and max(m.size for m in widest) <= 1200


def test_a_test_without_variance_is_no_error():
    from assaygrid.functions.stats import adf_of

    gram = np.array([[1.0, 0.5, 0.0], [0.5, -1e-3, 0.0], [0.0, 0.0, 20.0]])
    assert len(adf_of(gram, np.array([0.0, 1.0]), 22)) == 2
