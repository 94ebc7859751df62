"""Rollups that follow their tables, folders of workbooks, and statistics in SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaygrid.functions import sql, stats
from assaygrid.operators import results, rollups
from assaygrid.plans.stored import workbook_bytes
from assaygrid.sources import workbooks

HYPOTHESES = "id long, run_id string, round int"
MODELS = "id long, hypothesis_id long, match_score double, r_squared double"
CHECKS = "model_result_id long, overall_passed boolean"


@pytest.fixture()
def store(spark):
    h = spark.createDataFrame([(i, None if i == 9 else f"run{i % 3}", i % 2) for i in range(10)], HYPOTHESES)
    m = spark.createDataFrame([(i, i % 10, None if i % 7 == 0 else i / 50, i / 40) for i in range(40)], MODELS)
    v = spark.createDataFrame([(i, i % 3 == 0) for i in range(0, 40, 2)], CHECKS)
    return h, m, v


def rows(df):
    return sorted(str([None if v is None else round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select("run_id", "round", "avg_match", "max_r2", "n_models", "n_passed").collect())


def test_rollup_follows_its_tables(spark, tmp_path, store):
    h, m, v = store
    kept = rollups.Rollup(spark, str(tmp_path / "kept"))
    assert kept.read().count() == 0
    runs = h.select("run_id").distinct()
    kept.replace(rollups.partials(h, m.where("id < 20"), v), runs)
    assert rows(kept.read()) == rows(results.convergence(h, m.where("id < 20"), v))
    for a, b in ((20, 25), (25, 40)):
        kept.insert(rollups.partials(h, m.where(f"id >= {a} and id < {b}"), v))
        assert rows(kept.read()) == rows(results.convergence(h, m.where(f"id < {b}"), v))
    changed = m.withColumn("match_score", F.when(F.col("hypothesis_id") == 0, 0.0).otherwise(F.col("match_score")))
    kept.replace(rollups.partials(h, changed, v), spark.createDataFrame([("run0",)], "run_id string"))
    assert rows(kept.read()) == rows(results.convergence(h, changed, v))
    kept.delete(spark.createDataFrame([("run1",), (None,)], "run_id string"))
    left = h.where("run_id in ('run0', 'run2')")
    assert rows(kept.read()) == rows(results.convergence(left, changed, v))
    assert kept.versions() == [1, 2, 3, 4, 5]
    kept.compact()
    assert kept.versions() == [6] and rows(kept.read()) == rows(results.convergence(left, changed, v))
    kept.insert(rollups.partials(h.where("run_id = 'run1'"), m, v))
    assert rows(kept.read()) == rows(results.convergence(h.where("run_id is not null"), changed, v))


def test_only_changed_runs_are_written(spark, tmp_path, store):
    h, m, v = store
    kept = rollups.Rollup(spark, str(tmp_path / "kept"))
    kept.insert(rollups.partials(h, m, v))
    kept.insert(rollups.partials(h.where("run_id = 'run2'"), m, v))
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "kept/version=2")).select("run_id").distinct().collect()} == {"run2"}
    (tmp_path / "kept/version=3").mkdir()  # of a write that failed
    assert kept.versions() == [1, 2]


ROLES = ["Independent", "Independent", "", "Dependent"]


def test_a_folder_of_workbooks(spark, tmp_path):
    head = [["A study"], ROLES, ["condition", "time_min", " Dose (mg) ", "out"]]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.xlsx").write_bytes(workbook_bytes([*head, ["c1", 0.0, 1.5, 2.0], [None, None, None, None], ["c1", 1.0, None, " x "]]))
    (tmp_path / "in/a.xlsx").write_bytes(workbook_bytes([[None], *head, ["c2", 5.0, 2.0, 3.0]]))
    (tmp_path / "in/c.xlsx").write_bytes(workbook_bytes([ROLES, ["out", "condition", "more", "time_min"], [7.0, "c3", 1.0, 9.0]]))
    (tmp_path / "in/~c.xlsx").write_bytes(b"a lock file")
    df = workbooks.read_workbooks(spark, str(tmp_path / "in"))
    assert df.columns == ["file", "row_id", "condition", "time_min", "dose_mg", "out"] and df.rdd.getNumPartitions() == 3
    got = sorted(tuple(r) for r in df.collect())
    assert got == [("a.xlsx", 0, "c2", "5", "2", "3"), ("b.xlsx", 0, "c1", "0", "1.5", "2"), ("b.xlsx", 2, "c1", "1", None, "x"), ("c.xlsx", 0, "c3", "9", None, "7")]
    assert df.select("out").where("file = 'c.xlsx'").first()[0] == "7"
    assert workbooks.declared_roles(str(tmp_path / "in")).outputs == ["out"]
    assert workbooks.read_workbooks(spark, str(tmp_path / "in/b.xlsx")).count() == 2


def test_workbooks_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(b"not a workbook")
    (tmp_path / "b.xlsx").write_bytes(workbook_bytes([["x", "y"], [1.0, 2.0]]))
    with pytest.raises(Exception, match="workbook|zip"):
        workbooks.read_workbooks(spark, str(tmp_path)).collect()
    assert workbooks.read_workbooks(spark, str(tmp_path), mode="skip").count() == 0
    smart = workbooks.read_workbooks(spark, str(tmp_path), header="smart", mode="skip")
    assert [(r["x"], r["y"]) for r in smart.collect()] == [("1", "2")]
    (tmp_path / "none").mkdir()
    assert workbooks.read_workbooks(spark, str(tmp_path / "none")).count() == 0


def test_tails_in_sql(spark):
    sql.register_statistics(spark)
    cases = [(0.0, 5.0), (2.3, 7.0), (-2.3, 7.0), (40.0, 3.0), (None, 4.0), (1.0, 0.0), (float("nan"), 3.0)]
    got = [tuple(r) for r in spark.createDataFrame(cases, "x double, d double").selectExpr("t_sf(x, d)", "f_sf(x, d, d + 2)", "chi2_sf(x, d)").collect()]
    for (x, d), found in zip(cases, got, strict=True):
        want = [None] * 3 if x is None else [stats.t_sf2(x, d), stats.f_sf(x, d, d + 2), stats.chi2_sf(x, d)]
        assert all(v is None or v == pytest.approx(w, rel=1e-10) for v, w in zip(found, want, strict=True))
        assert all((v is None) == (w is None or math.isnan(w)) for v, w in zip(found, want, strict=True))


def test_tests_of_arrays_in_sql(spark):
    sql.register_statistics(spark)
    rng = np.random.default_rng(1)
    series = [np.cumsum(rng.normal(size=80)), rng.normal(size=80), rng.exponential(size=40), np.ones(20), np.zeros(0)]
    table = spark.createDataFrame([(i, [float(v) for v in s]) for i, s in enumerate(series)] + [(5, None), (6, [None, 1.0])], "i int, v array<double>")
    for r in table.selectExpr("i", "adf_p(v) as a", "shapiro_p(v) as s").collect():
        s = series[r["i"]] if r["i"] < len(series) else np.zeros(0)
        for got, p in ((r["a"], stats.adf(s)[1] if len(s) else math.nan), (r["s"], stats.shapiro(s)[1] if len(s) else math.nan)):
            assert got is None if math.isnan(p) else got == pytest.approx(p, rel=1e-10)


def test_gram_matrices_in_sql(spark):
    sql.register_statistics(spark)
    rng = np.random.default_rng(2)
    values = [("hot" if i % 4 else None, float(a), float(b) if i % 9 else None) for i, (a, b) in enumerate(rng.normal(size=(500, 2)))]
    df = spark.createDataFrame(values, "g string, a double, b double").repartition(6)
    got = {r["g"]: np.array(r["gram"]).reshape(3, 3) for r in sql.grams(df, ["g"], ["a", "b"]).collect()}
    df.createOrReplaceTempView("gram_test")
    plain = {r["g"]: np.array(r["m"]).reshape(3, 3) for r in spark.sql("select g, gram(array(1D, a, b)) as m from gram_test group by g").collect()}
    for g in ("hot", None):
        z = np.array([(1.0, a, b) for k, a, b in values if k == g and b is not None])
        assert got[g] == pytest.approx(z.T @ z, rel=1e-9) and plain[g] == pytest.approx(z.T @ z, rel=1e-9)


def test_grams_shuffle_matrices_not_rows(spark):
    from assaygrid.functions import sql

    rows = [(i % 3, float(i), float(i * i % 7) if i % 5 else None) for i in range(200)] + [(3, 1.0, None), (0, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double").repartition(5)
    found = sql.grams(df, ["k"], ["a", "b"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = {r["k"]: r["gram"] for r in found.collect()}
    assert set(got) == {0, 1, 2, 3} and got[3] is None
    for k in range(3):
        v = np.array([(1.0, a, b) for i, a, b in rows if i == k and b is not None and a == a])
        assert got[k] == pytest.approx((v.T @ v).ravel().tolist())
