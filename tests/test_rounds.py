"""A round of hypotheses: dispatch, transforms, validation and the best model, against plain numpy."""

import numpy as np
import pytest

from assaygrid.operators import models, rounds, screening


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for e in range(40):
        dose, ph = float(rng.exponential(3) + 0.1), float(rng.normal(7))
        level = rng.normal()
        for t in range(8):
            y = 2 * np.log(dose) + 0.8 * t + level + rng.normal() * 0.3 + (3 if e % 2 else 0)
            rows.append((e * 10 + t, e, float(t), dose, ph, float(rng.normal()) if (e + t) % 5 else None, float(y), "odd" if e % 2 else "even"))
    return spark.createDataFrame(rows, "row_id long, e int, t double, dose double, ph double, gaps double, y double, regime string").repartition(3)


H = rounds.Hypothesis


def by_id(found):
    return {m.id: m for m in found}


def test_families_are_dispatched(table):
    hs = [H("a", "ols", "y", ("dose", "t"), ("ph",)), H("b", "ridge", "y", ("dose", "t")), H("c", "fixed_effects", "y", ("t", "dose")), H("d", "random_effects", "y", ("t", "dose")), H("e", "lasso", "y", ("t", "dose", "ph"))]
    hs += [H("f", "xgboost", "y", ("t", "gaps")), H("g", "two_stage", "y", ("dose", "ph"), ("t",)), H("h", "kernel", "y", ("t",)), H("i", "ols", "nothing", ("t",)), H("j", "ols", "y", ("absent",), ("t",)), H("k", "fixed_effects", "y", ("t",))]
    import assaygrid.operators.boosting as boosting

    few = boosting.boost
    try:
        boosting.boost = lambda df, y, x: few(df, y, x, rounds=3)
        found, _, _ = rounds.fit_round(table, hs[:-1], "row_id", entity="e", time="t")
        alone, _, _ = rounds.fit_round(table, hs[-1:], "row_id", time="t")
    finally:
        boosting.boost = few
    m = by_id(found)
    assert {k for k, v in m.items() if v.success} == {"a_global", "b_global", "c_global", "d_global", "e_global", "f_global", "g_global_kinetics", "g_global_treatment"}
    assert "unknown family" in m["h_global"].error and "no column" in m["i_global"].error and "no primary" in m["j_global"].error and "entity" in alone[0].error
    g = screening.gram(table, ["dose", "t", "ph", "y"])
    want = screening.solve(g, "y", ("dose", "t", "ph"))
    assert m["a_global"].coefficients == pytest.approx({k: v for k, v in want.coefficients.items() if k != "const"}, rel=1e-9) and m["a_global"].n == want.n
    fe = models.fixed_effects(table, "y", ["t", "dose"], "e")
    assert m["c_global"].coefficients == pytest.approx(fe.coefficients) and m["c_global"].variables == ["t"]  # dose does not vary within
    assert m["f_global"].n == 320  # rows with gaps count
    assert m["a_global"].significant and m["a_global"].model_type == "ols" and m["g_global_treatment"].outcome == "auc"


def test_two_stages(table):
    """Runs are told apart by their inputs; areas by trapezoids in order of time, regressed on inputs that vary between runs."""
    m = by_id(rounds.fit_round(table, [H("g", "two_stage", "y", ("dose", "ph", "t"))], "row_id", time="t")[0])
    frame = table.toPandas().sort_values(["dose", "t"])
    runs = frame.groupby(["dose", "ph"])
    area = runs.apply(lambda r: np.trapezoid(r["y"], r["t"]), include_groups=False).reset_index(name="auc")
    x = np.column_stack([np.ones(len(area)), area["dose"], area["ph"]])
    b, *_ = np.linalg.lstsq(x, area["auc"], rcond=None)
    got = m["g_global_treatment"]
    assert got.n == 40 and [got.coefficients["dose"], got.coefficients["ph"]] == pytest.approx(b[1:], rel=1e-7)
    within = frame.assign(t=frame["t"] - runs["t"].transform("mean"), y=frame["y"] - runs["y"].transform("mean"))
    assert m["g_global_kinetics"].coefficients["t"] == pytest.approx((within["t"] @ within["y"]) / (within["t"] @ within["t"]), rel=1e-9)
    none = by_id(rounds.fit_round(table, [H("g", "two_stage", "y", ("dose",))], "row_id")[0])
    assert not none["g_global"].success
    short = by_id(rounds.fit_round(table.where("e < 3"), [H("g", "two_stage", "y", ("dose", "ph"))], "row_id", time="t")[0])
    assert short["g_global_kinetics"].success and "runs for" in short["g_global_treatment"].error


def test_transforms_and_products(table):
    hs = [H("a", "ols", "y", ("dose", "t"), (), (("dose", "t"),), (("dose", "log"), ("t", "log"), ("ph", "sqrt"))), H("b", "ols", "y", ("t",), (), (("t", "absent"),), (("t", "sqrt"),))]
    wide, inputs = rounds.designed(table, hs)
    assert inputs == {"a": ["log_dose", "t", "log_dose_x_t"], "b": ["sqrt_t"]}  # a time of zero has no logarithm
    r = wide.where("row_id = 13").first()
    assert r["log_dose_x_t"] == pytest.approx(np.log(r["dose"]) * 3) and r["sqrt_t"] == pytest.approx(3**0.5)


def test_validation_and_the_best_model(table):
    hs = [H("a", "ols", "y", ("dose", "t")), H("b", "ols", "y", ("ph",)), H("c", "kernel", "y", ("t",))]
    fitted, validations, best = rounds.run_round(table, hs, "row_id", regime="regime")
    m = {r["id"]: r for r in fitted.collect()}
    v = {r["model_result_id"]: r for r in validations.collect()}
    assert set(m) == set(v) and {k for k in m if m[k]["success"]} == {f"{h}_{label}" for h in "ab" for label in ("global", "odd", "even")}
    frame = table.toPandas()
    for label, part in (("global", frame), ("odd", frame[frame["regime"] == "odd"])):
        x = np.column_stack([np.ones(len(part)), part["dose"], part["t"]])
        y = part["y"].to_numpy()
        b, *_ = np.linalg.lstsq(x, y, rcond=None)
        e, fit = y - x @ b, x @ b
        assert m[f"a_{label}"]["r_squared"] == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum(), rel=1e-9)
        from assaygrid.functions.stats import chi2_sf, shapiro

        assert v[f"a_{label}"]["bp_p"] == pytest.approx(chi2_sf(len(y) * np.corrcoef(e**2, fit)[0, 1] ** 2, 1), rel=1e-6)
        assert v[f"a_{label}"]["shapiro_p"] == pytest.approx(shapiro(e)[1], rel=1e-6)
    assert v["a_global"]["max_vif"] == pytest.approx(1 / (1 - np.corrcoef(frame["dose"], frame["t"])[0, 1] ** 2), rel=1e-9)
    odd = frame.groupby("regime")["y"]
    between = sum(len(g) * (g.mean() - frame["y"].mean()) ** 2 for _, g in odd)
    assert v["a_global"]["eta_squared"] == pytest.approx(between / ((frame["y"] - frame["y"].mean()) ** 2).sum(), rel=1e-9) and v["a_global"]["anova_p"] < 0.05
    assert v["a_global"]["cv_r2"] > 0.2 > v["b_global"]["cv_r2"] and v["a_global"]["tests_run"] == 5 and v["b_global"]["tests_run"] == 4
    assert v["a_global"]["overall_passed"] == (v["a_global"]["tests_passed"] >= 4) and not v["c_global"]["overall_passed"]
    top = {r["hypothesis_id"]: r for r in best.collect()}
    passing = {h: [k for k in m if m[k]["hypothesis_id"] == h and m[k]["success"] and v[k]["overall_passed"]] for h in "ab"}
    for h in "ab":
        pool = passing[h] or [k for k in m if m[k]["hypothesis_id"] == h and m[k]["success"]]
        assert top[h]["model_id"] == max(pool, key=lambda k: m[k]["r_squared"]) and top[h]["passed"] == bool(passing[h]) and top[h]["pass_rate"] == pytest.approx(len(passing[h]) / 3)
    assert top["c"]["model_id"] is None and top["c"]["r_squared"] == 0.0 and not top["c"]["passed"]
    names = [r["variable"] for r in rounds.top_variables(fitted, best).collect()]
    assert "t" in names and "dose" in names


def test_folds_as_plain_fits(table):
    from pyspark.sql import functions as F

    hs = [H("a", "ols", "y", ("dose", "gaps"))]
    _, g, wide = rounds.fit_round(table, hs, "row_id", regime="regime")
    frame = wide.select("dose", "gaps", "y", F.col("_fold").alias("fold")).toPandas().dropna()
    want = []
    for fold in sorted(frame["fold"].unique()):
        a, b = frame[frame["fold"] != fold], frame[frame["fold"] == fold]
        design = lambda d: np.column_stack([np.ones(len(d)), d["dose"], d["gaps"]])
        beta, *_ = np.linalg.lstsq(design(a), a["y"], rcond=None)
        e = b["y"] - design(b) @ beta
        want.append(1 - (e**2).sum() / ((b["y"] - b["y"].mean()) ** 2).sum())
    assert rounds.cross_validated(g, "y", ["dose", "gaps"]) == pytest.approx(want, rel=1e-8)
