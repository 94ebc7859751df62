"""Exact quantiles against numpy, however values lie."""

import numpy as np
import pytest

from assaygrid.operators import clean, profile, quantiles


def test_bits_are_in_the_order_of_numbers():
    v = np.array([-np.inf, -1e300, -2.0, -1.0, -1e-300, -0.0, 0.0, 5e-324, 1e-300, 1.0, 1.0000000000000002, 2.0, 1e300, np.inf])
    u = quantiles.ordered_bits(v)
    assert (u[1:] >= u[:-1]).all() and u[5] == u[6] and len(set(u.tolist())) == len(v) - 1


@pytest.mark.parametrize("parts", [1, 5])
def test_quantiles_of_many_columns(spark, parts):
    rng = np.random.default_rng(3)
    n = 2001
    columns = {
        "normal": rng.normal(size=n),
        "tail": np.exp(rng.normal(size=n) * 40),
        "close": 1 + rng.integers(0, 5, n) * 2.0**-52,  # only the last bits differ
        "few": rng.integers(0, 3, n).astype(float),
        "same": np.full(n, -7.25),
        "signs": rng.choice([-0.0, 0.0, -1e-308, 1e-308, -np.inf, np.inf], n),
        "hot": np.where(rng.random(n) < 0.9, 3.0, rng.normal(size=n) * 1e6),
    }
    rows = [tuple(float(c[i]) for c in columns.values()) + (None if i % 3 else float(i), float("nan") if i % 2 else float(i), None) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns, "gaps", "nans", "none"])).repartition(parts)
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles.exact_quantiles(df, df.columns, probabilities)
    columns |= {"gaps": np.arange(0, n, 3, dtype=float), "nans": np.arange(0, n, 2, dtype=float)}
    for c, v in columns.items():
        s = np.sort(v)
        for p, q in zip(probabilities, got[c], strict=True):
            at = p * (len(s) - 1)
            low, high = s[int(np.floor(at))], s[int(np.ceil(at))]
            assert q == pytest.approx(low if low == high else low + (at - np.floor(at)) * (high - low), rel=1e-15), (c, p)
    assert got["none"] == [None] * len(probabilities)
    assert quantiles.exact_quantiles(df.where("few > 9"), ["few"], [0.5]) == {"few": [None]}


def test_what_is_built_on_quantiles(spark):
    df = spark.createDataFrame([(i, float(v) if v is not None else None, float(i % 3)) for i, v in enumerate([1, 2, 2, None, 3, 100, None])], "e long, v double, w double")
    assert sorted(r["v"] for r in clean.impute(df, ["v", "w"]).collect()) == [1, 2, 2, 2, 2, 3, 100]
    assert sorted(r["v"] for r in clean.impute(df, ["v", "w"], "mode").collect()) == [1, 2, 2, 2, 2, 3, 100]
    assert {r["name"]: r["outlier_count"] for r in profile.moments(df, ["v", "w"]).collect()} == {"v": 1, "w": 0}
    shape = profile.panel_shape(spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (3, 1), (3, 2), (3, 3)], "e int, t int"), "e", "t").first()
    assert shape["median_timepoints"] == 2.0 and shape["n_entities"] == 3
    with pytest.raises(ValueError):
        clean.one_hot(df, "e", most=3)
