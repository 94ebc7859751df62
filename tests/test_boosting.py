"""Boosted trees against a trainer in plain loops, split by split."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaygrid.operators import boosting


def lower_quantiles(v, bins):
    s = np.sort(v[~np.isnan(v)])
    if not len(s):
        return []
    return sorted({s[int(np.floor(k / bins * (len(s) - 1)))] for k in range(1, bins)} - {s[0]})


def shrunk(g, a):
    return max(abs(g) - a, 0.0) * (1 if g > 0 else -1)


def grown(x, g, rows, features, cuts, depth, least, l1, l2, step):
    """A tree as nested tuples (feature, threshold, missing left, left, right) or a leaf's value, trying every cut of every input both ways."""
    total, n = g[rows].sum(), len(rows)
    best = None
    if depth:
        for f in features:
            for c in cuts[f]:
                for missing_left in (True, False):
                    v = x[rows, f]
                    left = np.where(np.isnan(v), missing_left, v < c)
                    a, b = g[rows][left].sum(), int(left.sum())
                    if b < least or n - b < least:
                        continue
                    gain = 0.5 * (shrunk(a, l1) ** 2 / (b + l2) + shrunk(total - a, l1) ** 2 / (n - b + l2) - shrunk(total, l1) ** 2 / (n + l2))
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-8):
                        best = (gain, f, c, missing_left, left)
    if best is None:
        return -step * shrunk(total, l1) / (n + l2)
    _, f, c, missing_left, left = best
    more = lambda part: grown(x, g, rows[part], features, cuts, depth - 1, least, l1, l2, step)
    return f, c, missing_left, more(left), more(~left)


def nested(tree, node=0):
    s = tree.nodes[node]
    return s if isinstance(s, float) else (s.feature, s.threshold, s.missing_left, nested(tree, s.left), nested(tree, s.right))


def value(tree, row):
    while isinstance(tree, tuple):
        f, c, missing_left, a, b = tree
        tree = a if (missing_left if np.isnan(row[f]) else row[f] < c) else b
    return tree


def same(a, b):
    if isinstance(a, tuple):
        assert isinstance(b, tuple) and a[:3] == pytest.approx(b[:3])
        same(a[3], b[3])
        same(a[4], b[4])
    else:
        assert a == pytest.approx(b, rel=1e-7, abs=1e-10)


@pytest.mark.parametrize(("share", "columns", "fresh", "parts"), [(1.0, 1.0, 100, 1), (0.7, 0.6, 2, 4)])
def test_trees_as_plain_loops(spark, monkeypatch, share, columns, fresh, parts):
    monkeypatch.setattr(boosting, "FRESH", fresh)
    rng = np.random.default_rng(9)
    n, names = 400, ["a", "b", "few", "none"]
    x = np.column_stack([rng.normal(size=n), rng.exponential(size=n), rng.integers(0, 3, n).astype(float), np.full(n, np.nan)])
    x[rng.random(n) < 0.3, 0] = np.nan
    y = np.where(np.isnan(x[:, 0]), 3.0, x[:, 0]) + (x[:, 2] == 1) * 2 + 0.3 * x[:, 1] + rng.normal(size=n) * 0.1
    rows = [(*[None if np.isnan(v) and i % 2 else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))] + [(1.0, 1.0, 1.0, None, None), (1.0, 1.0, 1.0, None, float("nan"))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*names, "y"])).repartition(parts)
    m = boosting.boost(df, "y", names, rounds=5, depth=3, rows=share, columns=columns, bins=32)
    assert m.n == n
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ["y", *names]]
    marks = {(r["y"]): r["m"] for r in df.select(*clean).where("y is not null").withColumn("m", F.xxhash64("y", *names)).collect()}
    mark = np.array([marks[t] for t in y])
    cuts = [lower_quantiles(x[:, f], 32) for f in range(len(names))]
    assert m.cuts == cuts
    fitted, pick = np.full(n, y.mean()), np.random.default_rng(42)
    for number, tree in enumerate(m.trees):
        features = sorted(pick.choice(len(names), max(1, round(columns * len(names))), replace=False).tolist())
        inside = np.flatnonzero(boosting._in_sample(mark, number, share))
        want = grown(x, fitted - y, inside, features, cuts, 3, 3.0, 0.1, 1.0, 0.05)
        same(nested(tree), want)
        fitted += np.array([value(want, r) for r in x])
    assert m.r_squared == pytest.approx(1 - ((y - fitted) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel=1e-9)
    got = {r["y"]: r["prediction"] for r in m.predict(df).where("y is not null and not isnan(y)").collect()}
    assert [got[t] for t in y] == pytest.approx(fitted.tolist(), rel=1e-9)
    assert sum(m.importances().values()) == pytest.approx(1.0) and m.importances()["none"] == 0 and len(m.significant()) == 1


def test_samples_are_of_their_share():
    mark = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 100_000)
    shares = [boosting._in_sample(mark, t, 0.8).mean() for t in range(5)]
    assert shares == pytest.approx([0.8] * 5, abs=0.01)
    assert (boosting._in_sample(mark, 0, 0.8) & boosting._in_sample(mark, 1, 0.8)).mean() == pytest.approx(0.64, abs=0.01)


def test_few_rows_and_one_value(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(12)], "a double, y double")
    assert boosting.boost(df.limit(9), "y", ["a"], rounds=2) is None
    assert boosting.boost(df.where("a > 99"), "y", ["a"], rounds=2) is None
    flat = boosting.boost(df, "y", ["a"], rounds=2)
    assert flat.r_squared == 0.0 and flat.importances() == {"a": 0.0}


@pytest.mark.parametrize("share", [1.0, 0.7])
def test_cells_grow_the_trees_that_rows_grow(spark, monkeypatch, share):
    monkeypatch.setattr(boosting, "FRESH", 2)
    rng = np.random.default_rng(3)
    rows = [(float(a), None if b == 3 else float(b), float(a * 2 + (b == 3) * 4 + rng.normal())) for a, b in rng.integers(0, 6, (900, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y double").repartition(3)
    read = []
    plain = boosting._histograms
    monkeypatch.setattr(boosting, "_histograms", lambda data, *more: (read.append(data.count()), plain(data, *more))[1])
    by_cell = boosting.boost(df, "y", ["a", "b"], rounds=5, rows=share)
    assert max(read) <= 36
    monkeypatch.setattr(boosting, "SHARED", 10**9)
    by_row = boosting.boost(df, "y", ["a", "b"], rounds=5, rows=share)
    assert max(read) == 900 and by_cell.r_squared == pytest.approx(by_row.r_squared, rel=1e-9)
    for t, u in zip(by_cell.trees, by_row.trees, strict=True):
        same(nested(t), nested(u))


def test_trees_from_held_cells_are_those_of_passes(spark, monkeypatch):
    rng = np.random.default_rng(17)
    rows = [(None if a == 3 else float(a), float(b), float(b * b - 2 * a + c)) for a, b, c in zip(rng.integers(0, 5, 3000).tolist(), rng.integers(0, 7, 3000).tolist(), rng.normal(size=3000).tolist(), strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, y double").repartition(3)
    found = [boosting.boost(df, "y", ["a", "b"], rounds=25)]
    monkeypatch.setattr(boosting, "HELD", 0)
    found.append(boosting.boost(df, "y", ["a", "b"], rounds=25))
    monkeypatch.setattr(boosting, "SHARED", 10**6)  # rows, not cells
    found.append(boosting.boost(df, "y", ["a", "b"], rounds=25))
    for other in found[1:]:
        assert abs(found[0].r_squared - other.r_squared) < 1e-9 and len(other.trees) == 25
        assert other.importances() == pytest.approx(found[0].importances(), abs=1e-9)


def test_boosted_trees_query_grows_every_tree(spark, monkeypatch):
    from assaygrid.plans import panels

    seen = []

    def grown(df, y, x, **options):
        seen.append(options)
        return boosting.Boosted(x, 0.0, [[]] * len(x), [], 1, 0.0, 0.0)

    whole = inspect.signature(boosting.boost).parameters
    monkeypatch.setattr(panels.boosting, "boost", grown)
    panels.boosted_trees(spark, "/root/testdata/sf0.001")
    assert {k: v for k, v in seen[0].items() if v != whole[k].default} == {}
    assert (whole["rounds"].default, whole["depth"].default, whole["step"].default) == (300, 3, 0.05)
