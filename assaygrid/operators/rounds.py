"""A round of hypotheses: every family fitted, validated and the best model picked (MD13, MD18, MD19, DG18, DG26).

Least-squares hypotheses of a round share their passes: one Gram pass by regime and fold gives the fit over all rows, the one of each
regime and the cross-validation of all of them; one pass gives the residual tests of all fits over all rows, one those of all
regimes. Other families are fitted one by one. What cannot be fitted is a result with its message.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.functions.stats import f_sf, shapiro
from assaygrid.operators import boosting, models, panel, screening
from assaygrid.operators.screening import Fit, Gram

FAMILIES = ("ols", "ridge", "fixed_effects", "random_effects", "lasso", "gradient_boosting", "xgboost", "two_stage")
# What a validation test passes at.
MAX_VIF, ALPHA, HIGH_ALPHA, FOLDS, SAMPLE, LEAST_REGIME = 5.0, 0.05, 0.01, 5, 5000, 10
_FOLD = "_fold"


@dataclass(frozen=True)
class Hypothesis:
    id: str
    family: str
    outcome: str
    primary: tuple[str, ...]
    controls: tuple[str, ...] = ()
    interactions: tuple[tuple[str, str], ...] = ()
    transforms: tuple[tuple[str, str], ...] = ()  # column, "log" or "sqrt"

    @property
    def inputs(self) -> list[str]:
        return list(dict.fromkeys([*self.primary, *self.controls]))


@dataclass
class Model:
    """What a fit is, whatever its family; label: global or a regime."""

    hypothesis: str
    label: str
    model_type: str
    outcome: str
    variables: list[str]
    success: bool = True
    error: str | None = None
    n: int = 0
    r_squared: float = 0.0
    adj_r_squared: float = 0.0
    coefficients: dict[str, float] = field(default_factory=dict)
    p_values: dict[str, float] = field(default_factory=dict)
    significant: list[str] = field(default_factory=list)
    highly_significant: list[str] = field(default_factory=list)
    fit: Fit | None = None

    @property
    def id(self) -> str:
        return f"{self.hypothesis}_{self.label}" + {"two_stage_kinetics": "_kinetics", "two_stage_treatment": "_treatment"}.get(self.model_type, "")


def _failed(h: Hypothesis, label: str, message: str, kind: str | None = None) -> Model:
    return Model(h.id, label, kind or h.family, h.outcome, [], False, message[:200])


def designed(df: DataFrame, hypotheses: list[Hypothesis]) -> tuple[DataFrame, dict[str, list[str]]]:
    """df with the columns that hypotheses' transforms and products make, and the inputs of each by its id.

    A transform applies where its domain allows: log if all values are above zero, sqrt if none is below; one aggregate tells for all.
    """
    asked = {(c, how) for h in hypotheses for c, how in h.transforms if c in df.columns}
    low = df.agg(*[F.min(F.col(f"`{c}`").cast("double")).alias(c) for c in sorted({c for c, _ in asked})]).first() if asked else None
    made: dict[str, object] = {}
    inputs: dict[str, list[str]] = {}
    for h in hypotheses:
        names = {}
        for c in h.inputs:
            how = dict(h.transforms).get(c)
            if c in df.columns and how and low[c] is not None and (how == "log" and low[c] > 0 or how == "sqrt" and low[c] >= 0):
                names[c] = f"{how}_{c}"
                made[names[c]] = {"log": F.ln, "sqrt": F.sqrt}[how](F.col(f"`{c}`").cast("double"))
            elif c in df.columns:
                names[c] = c
        inputs[h.id] = list(names.values())
        for a, b in h.interactions:
            if a in names and b in names:
                name = f"{names[a]}_x_{names[b]}"
                made[name] = (made.get(names[a], F.col(f"`{a}`").cast("double"))) * (made.get(names[b], F.col(f"`{b}`").cast("double")))
                inputs[h.id].append(name)
    return df.withColumns(made) if made else df, inputs


def _summed(g: Gram, keep) -> Gram:
    """The Gram of the groups that keep says, as one."""
    out: dict[int, np.ndarray] = {}
    for group, masks in g.sums.items():
        if keep(group):
            for mask, m in masks.items():
                out[mask] = out.get(mask, 0) + m
    return Gram(g.variables, g.shift, g.scale, {(): out})


def _of_fit(h: Hypothesis, label: str, f: Fit) -> Model:
    p = {k: v for k, v in f.p_values.items() if k != "const"}
    significant = [k for k, v in p.items() if v < ALPHA]
    return Model(h.id, label, h.family, h.outcome, list(f.x), True, None, f.n, f.r_squared, f.adj_r_squared, {k: v for k, v in f.coefficients.items() if k != "const"}, p, significant, [k for k in significant if p[k] < HIGH_ALPHA], f)


def treatment_stage(df: DataFrame, h: Hypothesis, label: str, entity: str, time: str, row_id: str) -> Model:
    """MD13: least squares of runs' areas on the inputs that vary between runs alone, dense over runs; three runs more than inputs at least."""
    names = [c for c in h.inputs if c in df.columns and c not in (time, entity)]
    split = {r["column"]: r["class"] for r in panel.split_predictors(df, names, entity).collect()} if names else {}  # a row an input
    between = [c for c in names if split[c] == "between_entity"]
    if not between:
        return _failed(h, label, "no inputs that vary between runs", "two_stage_treatment")
    frame = panel.two_stage_treatment(df, h.outcome, entity, time, between, row_id)
    dense = [c for c in frame.columns if c not in ("entity", "auc")]
    if not dense:
        return _failed(h, label, "no dense inputs of runs", "two_stage_treatment")
    g = screening.gram(frame, [*dense, "auc"])
    n = int(round(screening.complete(g, [*dense, "auc"])[0, 0]))
    f = screening.solve(g, "auc", tuple(dense), least=4)
    if f is None:
        return _failed(h, label, f"{n} runs for {len(dense)} inputs", "two_stage_treatment")
    m = _of_fit(h, label, f)
    m.model_type, m.outcome, m.fit = "two_stage_treatment", "auc", None
    return m


def _panel_model(h: Hypothesis, label: str, fe: models.PanelFit, kind: str) -> Model:
    significant = [k for k, v in fe.p_values.items() if v < ALPHA]
    return Model(h.id, label, kind, fe.y, fe.x, True, None, fe.n, fe.within_r2, fe.within_r2, fe.coefficients, fe.p_values, significant, [k for k in significant if fe.p_values[k] < HIGH_ALPHA])


def _single(df: DataFrame, h: Hypothesis, x: list[str], label: str, entity: str | None, time: str | None, row_id: str) -> list[Model]:
    """The models of a family that is not least squares."""
    try:
        if h.family in ("fixed_effects", "random_effects"):
            if entity is None:
                return [_failed(h, label, f"{h.family} needs an entity column")]
            if h.family == "fixed_effects":
                fe = models.fixed_effects(df, h.outcome, x, entity)
                return [_panel_model(h, label, fe, h.family) if fe else _failed(h, label, "too few rows or entities, or nothing that varies within them")]
            re = models.random_effects(df, h.outcome, x, entity)
            return [_of_fit(h, label, re) if re else _failed(h, label, "too few rows or entities")]
        if h.family == "lasso":
            path = models.lasso_cv(df, h.outcome, x, row_id)
            kept = [c for c, b in path["coefficients"].items() if b and c != "const"]
            return [Model(h.id, label, h.family, h.outcome, x, True, None, path.get("n", 0), path["cv_r2"], path["cv_r2"], path["coefficients"], {}, kept, kept[: max(1, len(kept) // 2)])]
        if h.family in ("gradient_boosting", "xgboost"):
            if h.family == "xgboost":
                b = boosting.boost(df, h.outcome, x)
                if b is None:
                    return [_failed(h, label, "too few rows with the outcome")]
                shares, n, r2, adj = b.importances(), b.n, b.r_squared, b.adj_r_squared
            else:
                t = models.tree_model(df, h.outcome, x, "gbt")
                n = df.where(F.col(f"`{h.outcome}`").isNotNull()).count()
                shares, r2 = t["importances"], t["r_squared"]
                adj = 1 - (1 - r2) * (n - 1) / (n - len(x) - 1) if n > len(x) + 1 else r2
            ranked = sorted(shares, key=lambda c: -shares[c])
            top = ranked[: max(1, len(ranked) // 3)]
            return [Model(h.id, label, h.family, h.outcome, x, True, None, n, r2, adj, shares, {}, top, top[: max(1, len(top) // 2)])]
        if time is None:
            return [_failed(h, label, "two_stage needs a time column")]
        keyed = panel.derive_entity(df, [c for c in h.inputs if c in df.columns and c != time], row_id, "_run")
        kinetics = models.two_stage_kinetics(keyed, h.outcome, "_run", time)
        first = _panel_model(h, label, kinetics, "two_stage_kinetics") if kinetics else _failed(h, label, "too few rows or runs", "two_stage_kinetics")
        return [first, treatment_stage(keyed, h, label, "_run", time, row_id)]
    except Exception as e:  # noqa: BLE001  a model that cannot be fitted is a result
        return [_failed(h, label, str(e))]


def fit_round(df: DataFrame, hypotheses: list[Hypothesis], row_id: str, entity: str | None = None, time: str | None = None, regime: str | None = None) -> tuple[list[Model], Gram | None, DataFrame]:
    """Models of all hypotheses over all rows and in each regime of LEAST_REGIME rows or more; the Gram by regime and fold; df as designed."""
    wide, inputs = designed(df, [h for h in hypotheses if h.outcome in df.columns])
    linear = [h for h in hypotheses if h.family in ("ols", "ridge") and inputs.get(h.id)]
    g, labels = None, {}
    if regime:
        counts = wide.groupBy(screening._regime(regime).alias("g")).count().collect()  # a row a regime
        labels = {r["g"]: r["count"] for r in counts if r["count"] >= LEAST_REGIME}
    wide = wide.withColumn(_FOLD, F.pmod(F.xxhash64(row_id), F.lit(FOLDS)).cast("string")).withColumn("_regime", screening._regime(regime))
    if linear:
        names = list(dict.fromkeys(c for h in linear for c in (*inputs[h.id], h.outcome)))
        g = screening.gram(wide, names, ["_regime", _FOLD])
    out: list[Model] = []
    for h in hypotheses:
        x = inputs.get(h.id)
        if h.family not in FAMILIES:
            out.append(_failed(h, "global", f"unknown family {h.family}"))
        elif h.outcome not in df.columns:
            out.append(_failed(h, "global", f"no column {h.outcome}"))
        elif not [c for c in h.primary if c in df.columns]:
            out.append(_failed(h, "global", "no primary input is there"))
        else:
            for label in ["global", *sorted(labels)]:
                if h in linear:
                    part = _summed(g, lambda k, label=label: label == "global" or k[0] == label)
                    n = int(round(screening.complete(part, [*x, h.outcome])[0, 0]))
                    f = screening.solve(part, h.outcome, tuple(x), ridge=1.0 if h.family == "ridge" else 0.0, least=5, more=2)
                    out.append(_of_fit(h, label, f) if f else _failed(h, label, f"{n} complete rows for {len(x)} inputs"))
                else:
                    rows = wide if label == "global" else wide.where(F.col("_regime") == label)
                    out += _single(rows, h, x, label, entity, time, row_id)
    return out, g, wide


def cross_validated(g: Gram, y: str, x: list[str]) -> list[float]:
    """DG18: R2 on each of the folds of a fit on the others, rows dealt to folds by a hash."""
    out = []
    for fold in sorted({k[1] for k in g.sums}):
        rest, held = _summed(g, lambda k, fold=fold: k[1] != fold), _summed(g, lambda k, fold=fold: k[1] == fold)
        f = screening.solve(rest, y, tuple(x))
        m = screening.complete(held, [*x, y])
        if f is None or m[0, 0] < 2:
            continue
        at = [g.variables.index(v) for v in (*x, y)]
        t = np.zeros((len(at) + 1, len(at) + 1))
        t[0, 0], t[1:, 0], t[1:, 1:] = 1, g.shift[at], np.diag(g.scale[at])
        raw = t @ m @ t.T
        w = np.array([-f.coefficients["const"], *[-f.coefficients[v] for v in x], 1.0])
        sst = raw[-1, -1] - raw[0, -1] ** 2 / raw[0, 0]
        if sst > 0:
            out.append(float(1 - (w @ raw @ w) / sst))
    return out


def validate_round(wide: DataFrame, found: list[Model], g: Gram | None, row_id: str, regime: str | None = None) -> list[dict]:
    """DG26: of each model: tests_run, tests_passed, overall_passed and what the tests saw.

    Multicollinearity of two inputs or more, normality and even spread of residuals, differences between regimes, cross-validation.
    Models without residuals of their own (other families) are held to the tests that need none.
    """
    fitted = [m for m in found if m.success and m.fit is not None and math.isfinite(m.fit.sse) and m.fit.sse > 0 and set(m.fit.x) <= set(wide.columns)]
    whole, parts = [m for m in fitted if m.label == "global"], [m for m in fitted if m.label != "global"]
    spread = dict(zip([m.id for m in whole], screening.residual_tests(wide, [m.fit for m in whole], row_id), strict=True))
    spread |= dict(zip([m.id for m in parts], screening.residual_tests(wide, [m.fit for m in parts], row_id, "_regime", [m.label for m in parts]), strict=True))
    normal = _normality(wide, fitted, row_id)
    varied = {}
    if regime:
        for y in sorted({m.outcome for m in found if m.success and m.outcome in wide.columns}):
            r = models.anova(wide, y, "_regime").first()
            varied[y] = (0.0, 1.0, True, None) if r is None or r["f"] is None else (r["f"], p := f_sf(r["f"], r["n_groups"] - 1, r["n"] - r["n_groups"]), p < ALPHA, r["eta_squared"])
    total = _summed(g, lambda k: True) if g else None
    out = []
    for m in found:
        d = {"model_result_id": m.id, "tests_run": 0, "tests_passed": 0, "max_vif": None, "shapiro_p": None, "bp_p": None, "anova_p": None, "cv_r2": None, "eta_squared": None, "overall_passed": False}
        if m.success:
            tests = []
            known = total is not None and set(m.variables) <= set(total.variables) and m.outcome in total.variables
            if m.model_type not in ("gradient_boosting", "lasso") and len(m.variables) > 1 and known:
                d["max_vif"] = _vif(total, m.variables)
                tests.append(d["max_vif"] < MAX_VIF)
            if m.id in normal:
                d["shapiro_p"] = normal[m.id]
                tests.append(normal[m.id] > ALPHA)
            if m.id in spread and spread[m.id]["bp_lite_p"] is not None:
                d["bp_p"] = spread[m.id]["bp_lite_p"]
                tests.append(d["bp_p"] > ALPHA)
            if m.outcome in varied:
                _, d["anova_p"], passed, d["eta_squared"] = varied[m.outcome]
                tests.append(passed)
            if known and m.variables:
                folds = cross_validated(g, m.outcome, m.variables)
                d["cv_r2"] = float(np.mean(folds)) if folds else 0.0
                tests.append(d["cv_r2"] > 0 or not folds)
            d |= {"tests_run": len(tests), "tests_passed": sum(tests), "overall_passed": sum(tests) >= max(1, len(tests) - 1)}
        out.append(d)
    return out


def _vif(g: Gram, names: list[str]) -> float:
    """The greatest inflation of a variance, over rows that have all inputs."""
    m = screening.complete(g, names)
    c = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / m[0, 0]
    d = np.sqrt(np.maximum(np.diag(c), 1e-300))
    return float(np.diag(np.linalg.pinv(c / np.outer(d, d))).max())


def _normality(wide: DataFrame, fitted: list[Model], row_id: str) -> dict[str, float]:
    """Shapiro and Wilk's p of residuals, of up to SAMPLE rows of each regime by a hash of row_id, which the test is defined for."""
    if not fitted:
        return {}
    names = sorted({v for m in fitted for v in (*m.fit.x, m.fit.y)})
    picked = wide.select("_regime", F.xxhash64(row_id).alias("_h"), *[F.col(f"`{v}`").cast("double").alias(v) for v in names])
    over = Window.partitionBy("_regime").orderBy("_h")
    rows = picked.withColumn("_n", F.row_number().over(over)).where(F.col("_n") <= SAMPLE).toPandas()  # SAMPLE rows a regime
    out = {}
    for m in fitted:
        part = rows if m.label == "global" else rows[rows["_regime"] == m.label]
        part = part.sort_values("_h")[[*m.fit.x, m.fit.y]]
        part = part[np.isfinite(part.to_numpy(float)).all(axis=1)].head(SAMPLE).to_numpy(float)
        e = part[:, -1] - m.fit.coefficients["const"] - part[:, :-1] @ np.array([m.fit.coefficients[v] for v in m.fit.x])
        if len(e) >= 12 and np.ptp(e) > 0:
            out[m.id] = float(shapiro(e)[1])
    return out


def run_round(df: DataFrame, hypotheses: list[Hypothesis], row_id: str, entity: str | None = None, time: str | None = None, regime: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MD19: (models, validations, best) of a round. best: of each hypothesis its best model by R2 among those that passed, or else among those
    that succeeded: hypothesis_id, model_id, r_squared, passed, pass_rate."""
    spark = df.sparkSession
    found, g, wide = fit_round(df, hypotheses, row_id, entity, time, regime)
    checks = validate_round(wide, found, g, row_id, regime)
    rows = [(m.id, m.hypothesis, m.label, m.model_type, m.success, m.error, m.n, float(m.r_squared), float(m.adj_r_squared), m.coefficients, m.p_values, m.significant, m.highly_significant) for m in found]
    table = spark.createDataFrame(rows, "id string, hypothesis_id string, label string, model_type string, success boolean, error_message string, n long, r_squared double, adj_r_squared double, coefficients map<string,double>, p_values map<string,double>, significant_variables array<string>, highly_significant array<string>")
    schema = "model_result_id string, tests_run int, tests_passed int, max_vif double, shapiro_p double, bp_p double, anova_p double, cv_r2 double, eta_squared double, overall_passed boolean"
    validations = spark.createDataFrame([tuple(d[c.split()[0]] for c in schema.split(", ")) for d in checks], schema)
    both = table.join(validations, table["id"] == validations["model_result_id"])
    passed = F.col("success") & F.col("overall_passed")
    rank = F.struct(passed.alias("p"), F.col("r_squared").alias("r"))
    best = both.groupBy("hypothesis_id").agg(F.max_by("id", F.when(F.col("success"), rank)).alias("model_id"), F.max(F.when(F.col("success"), rank)).alias("top"), F.avg(passed.cast("double")).alias("pass_rate"))
    return table, validations, best.select("hypothesis_id", "model_id", F.coalesce("top.r", F.lit(0.0)).alias("r_squared"), F.coalesce("top.p", F.lit(False)).alias("passed"), "pass_rate")


def top_variables(models_: DataFrame, best: DataFrame) -> DataFrame:
    """Variables by how many hypotheses' best models have them as significant."""
    chosen = models_.join(best.select(F.col("model_id").alias("id")), "id")
    return chosen.select(F.explode("significant_variables").alias("variable")).groupBy("variable").count().orderBy(F.desc("count"), "variable")
