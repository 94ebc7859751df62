"""Boosted trees from cells against MLlib's on rows, fit by fold."""

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from assaygrid.operators import fold_boosting, models


@pytest.mark.parametrize("fresh", [2, 100])
def test_all_fits_as_mllib_grows_them(spark, monkeypatch, fresh):
    monkeypatch.setattr(fold_boosting, "FRESH", fresh)
    rng = np.random.default_rng(4)
    n = 1500
    a, b, c = rng.integers(0, 20, n), rng.integers(0, 7, n), rng.integers(0, 3, n)
    y = a * 1.5 + (b > 3) * 4 + c * b + rng.normal(size=n)
    rows = [(None if i % 11 == 0 else float(p), float(q), float(r), float(t)) for i, (p, q, r, t) in enumerate(zip(a, b, c, y, strict=True))] + [(1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(3)
    x = ["a", "b", "c"]
    got = models.tree_model(df, "y", x, "gbt", maxIter=6, stepSize=0.3)
    data = models._assembled(df.withColumn("h", F.xxhash64(*x, "y", F.lit(42))), "y", x, "h").persist()

    def fit(part):
        return GBTRegressor(seed=42, maxIter=6, maxDepth=3, stepSize=0.3).fit(part)

    def r2(m, part):
        p = np.array([(r["label"], r["prediction"]) for r in m.transform(part).collect()])
        return 1 - ((p[:, 0] - p[:, 1]) ** 2).sum() / ((p[:, 0] - p[:, 0].mean()) ** 2).sum()

    whole = fit(data)
    assert got["r_squared"] == pytest.approx(r2(whole, data), abs=1e-9)
    assert got["cv_r2"] == pytest.approx(np.mean([r2(fit(data.where(F.pmod("h", F.lit(5)) != i)), data.where(F.pmod("h", F.lit(5)) == i)) for i in range(5)]), abs=1e-9)
    shares = whole.featureImportances.toArray()
    assert [got["importances"][v] for v in x] == pytest.approx([shares[i] + shares[i + 3] for i in range(3)], abs=1e-9)


def test_passes_read_cells_not_rows(spark):
    df = spark.range(4, numPartitions=2).selectExpr("cast(id % 2 as int) as fold", "cast(id as double) as y", "cast(id % 2 as double) as x")
    read = []
    for copies in (1, 500):
        rows = df.crossJoin(spark.range(copies)).drop("id")
        blocks = fold_boosting._blocks(rows, ["x"], [[0.5]], 2, 0.0).collect()
        read.append(sum(r["cells"] for r in blocks))
        n = sum(np.frombuffer(r["n"]).reshape(2, -1).sum(1) for r in blocks)
        assert n.tolist() == [2.0 * copies] * 2
    assert read == [2, 2]


def test_cuts_between_values():
    assert fold_boosting.cuts_of([(3.0, 1), (1.0, 5)], 31) == [2.0]
    assert fold_boosting.cuts_of([(float(i), 1) for i in range(8)], 3) == [1.5, 3.5, 5.5]
    assert fold_boosting.cuts_of([(1.0, 4)], 31) == [] and fold_boosting.cuts_of([], 31) == []


def test_many_values_are_cut_by_ranks(spark, monkeypatch):
    df = spark.range(3000, numPartitions=3).selectExpr("cast(id as double) as u", "case when id < 2000 then 0D else cast(id as double) end as v")
    listed = fold_boosting.all_cuts(df, ["u", "v"], 7)
    monkeypatch.setattr(fold_boosting, "LISTED", 100)
    ranked = fold_boosting.all_cuts(df, ["u", "v"], 7)
    assert [len(c) for c in ranked] == [len(c) for c in listed] and np.abs(np.subtract(listed[0], ranked[0])).max() < 5


def test_nothing_to_split_on_and_nan(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(12)] + [(1.0, float("nan"))], "a double, y double")
    flat = models.tree_model(df, "y", ["a"], "gbt", maxIter=2)
    assert flat["r_squared"] == pytest.approx(0.0) and flat["importances"] == {"a": 0.0}
    df = spark.createDataFrame([(float("nan") if i % 2 else None, float(i % 2)) for i in range(12)] + [(2.0, 5.0)] * 6, "a double, y double")
    assert models.tree_model(df, "y", ["a"], "gbt", maxIter=2)["r_squared"] > 0.9


def test_a_tree_of_all_fits_is_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i % 3, float(a - b * c + d), *map(float, (a, b, c, d))) for i, (a, b, c, d) in enumerate(rng.integers(0, 5, (800, 4)).tolist())]
    df = spark.createDataFrame(rows, "fold int, y double, a double, b double, c double, d double").repartition(3)
    passes, plain = [], type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: passes.append(1) or plain(self))
    at_once = fold_boosting.boost_folds(df, ["a", "b", "c", "d"], 3, rounds=6, step=0.3)
    assert len(passes) == 6  # of 18 levels
    monkeypatch.setattr(fold_boosting, "SUMS", 0)
    by_level = fold_boosting.boost_folds(df, ["a", "b", "c", "d"], 3, rounds=6, step=0.3)
    assert len(passes) == 6 + 18
    assert at_once.gains == pytest.approx(by_level.gains) and at_once.r_squared == pytest.approx(by_level.r_squared, abs=1e-12) and at_once.held == pytest.approx(by_level.held, abs=1e-12)


def test_fits_of_many_rows_run_in_turn(spark, monkeypatch):
    import threading

    lock, now, most, plain = threading.Lock(), [0], [], models.RandomForestRegressor.fit

    def fit(self, data):
        with lock:
            now[0] += 1
            most.append(now[0])
        try:
            return plain(self, data)
        finally:
            with lock:
                now[0] -= 1

    monkeypatch.setattr(models.RandomForestRegressor, "fit", fit)
    df = spark.createDataFrame([(float(i % 7), float(i % 7 + i % 3)) for i in range(60)], "a double, y double")
    monkeypatch.setattr(models, "BESIDE", 59, raising=False)
    found = models.tree_model(df, "y", ["a"], "forest", numTrees=2, maxDepth=2)
    assert most == [1] * 6 and found["r_squared"] > 0.5
