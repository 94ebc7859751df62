"""Statistics for SQL (§2.19): tails of distributions, tests of short series and Gram matrices, registered by name."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.functions.stats import adf, chi2_sf, f_sf, shapiro, t_sf2

def _each(f: Callable[..., float], *columns: pa.Array) -> pa.Array:
    """f of each row; null where an argument is null or the result is no number."""
    rows = zip(*(c.to_pylist() for c in columns), strict=True)
    found = [None if any(v is None for v in r) else f(*map(float, r)) for r in rows]
    return pa.array([None if v is None or math.isnan(v) else v for v in found], pa.float64())


def _test(f: Callable[[np.ndarray], tuple[float, float]], column: pa.Array) -> pa.Array:
    """The p-value of a test of each row's array, without its nulls and NaN."""
    found = []
    for values in column.to_pylist():
        v = np.array([x for x in values or [] if x is not None and math.isfinite(x)], float)
        p = f(v)[1] if len(v) else math.nan
        found.append(None if math.isnan(p) else p)
    return pa.array(found, pa.float64())


def _outer(rows: pa.Array) -> list[float] | None:
    """The sum of outer products of arrays of equal length; arrays with a null or NaN are left out."""
    known = rows.drop_null()
    if not len(known):
        return None
    widths = np.unique(known.value_lengths().to_numpy())
    if len(widths) > 1:
        raise ValueError("arrays of different lengths")
    v = known.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(known), widths[0])
    v = v[~np.isnan(v).any(axis=1)]
    return (v.T @ v).ravel().tolist() if len(v) else None


def _added(rows: pa.Array) -> list[float] | None:
    """The sum of arrays, place by place."""
    parts = [np.array(v, float) for v in rows.to_pylist() if v is not None]
    return sum(parts[1:], parts[0]).tolist() if parts else None


def register_statistics(spark: SparkSession) -> None:
    """t_sf(t, df) two-sided, f_sf(f, d1, d2), chi2_sf(x, df), adf_p(array), shapiro_p(array): p-values, by Arrow batches.

    gram(array) and gram_sum(array): aggregates. gram sums outer products, so of (1, x, ..., y) it gives all that a regression needs;
    gram_sum adds such matrices. A whole group of gram goes to one task: group by a slice as well and add the slices' up
    where groups may be large, or use grams().
    """

    @F.arrow_udf("double")
    def t_sf(t: pa.Array, df: pa.Array) -> pa.Array:
        return _each(t_sf2, t, df)

    @F.arrow_udf("double")
    def f_tail(f: pa.Array, d1: pa.Array, d2: pa.Array) -> pa.Array:
        return _each(f_sf, f, d1, d2)

    @F.arrow_udf("double")
    def chi2_tail(x: pa.Array, df: pa.Array) -> pa.Array:
        return _each(chi2_sf, x, df)

    @F.arrow_udf("double")
    def adf_p(series: pa.Array) -> pa.Array:
        return _test(adf, series)

    @F.arrow_udf("double")
    def shapiro_p(values: pa.Array) -> pa.Array:
        return _test(shapiro, values)

    for name, f in {"t_sf": t_sf, "f_sf": f_tail, "chi2_sf": chi2_tail, "adf_p": adf_p, "shapiro_p": shapiro_p, "gram": _aggregate(_outer), "gram_sum": _aggregate(_added)}.items():
        spark.udf.register(name, f)


def _aggregate(f: Callable[[pa.Array], list[float] | None]):
    from pyspark.sql.functions import ArrowUDFType

    return F.arrow_udf(lambda rows: f(rows), "array<double>", ArrowUDFType.GROUPED_AGG)


def grams(df: DataFrame, by: list[str], values: list[str | Column]) -> DataFrame:
    """by and gram: the matrix of (1, values) of each group, row by row, over rows that have all values.

    Products are summed where the rows lie; what is shuffled are matrices, whatever the size of a group.
    """
    each = [F.lit(1.0), *[(F.col(f"`{v}`") if isinstance(v, str) else v).cast("double") for v in values]]
    names = [f"_v{i}" for i in range(len(each))]
    rows = df.select(*[F.col(f"`{b}`") for b in by], *[v.alias(name) for v, name in zip(each, names, strict=True)])
    have = F.lit(True)
    for name in names:
        have = have & F.coalesce(~F.isnan(name), F.lit(False)) & F.col(name).isNotNull()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    parts = rows.withColumn("_have", have).groupBy(*by).agg(*[F.sum(F.when(F.col("_have"), F.col(names[i]) * F.col(names[j]))).alias(f"_p{i}_{j}") for i, j in pairs])
    matrix = F.array(*[F.col(f"_p{min(i, j)}_{max(i, j)}") for i in range(len(names)) for j in range(len(names))])
    return parts.select(*[F.col(f"`{b}`") for b in by], F.when(F.col("_p0_0").isNotNull(), matrix).alias("gram"))
