"""Column profiles and checks of a table (AG1-AG10, AG18-AG20, RD8-RD16, FL1-FL2), each in one or two passes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaygrid.operators.quantiles import exact_quantiles

# Names that a range check goes by, with their bounds.
RANGES = (("ph", 0.0, 14.0), ("temperature", -10.0, 100.0), ("uv_intensity", 0.0, None), ("concentration", 0.0, None), ("time", 0.0, None), ("dose", 0.0, None))
ID_WORDS = ("id", "entity", "sample", "unit", "experiment")
TIME_WORDS = ("time", "hour", "day", "date", "minute", "timestamp")


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson's r over rows that have both; null where either is constant (F.corr divides by zero there)."""
    a, b = a.cast("double"), b.cast("double")
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))


def profile(df: DataFrame, samples: int = 5) -> DataFrame:
    """AG1: a row for each column: dtype, n_unique, n_missing, missing_pct, min, max, mean, std, sample_values, is_numeric, is_categorical.

    One aggregate over the table, unpivoted; distinct values are counted column by column, each branch reading its column alone,
    so no row is expanded. sample_values: the least distinct values as strings, from a further pass.
    """
    numeric = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema.fields}
    kinds = dict(df.dtypes)
    parts = []
    for c, num in numeric.items():
        x = _col(c)
        d = x.cast("double") if num else F.lit(None).cast("double")
        parts.append(
            F.struct(
                F.lit(c).alias("name"),
                F.lit(kinds[c]).alias("dtype"),
                (F.count(F.lit(1)) - F.count(x)).alias("n_missing"),
                F.round(100 * F.try_divide((F.count(F.lit(1)) - F.count(x)).cast("double"), F.count(F.lit(1)).cast("double")), 2).alias("missing_pct"),
                F.min(d).alias("min"),
                F.max(d).alias("max"),
                F.round(F.avg(d), 4).alias("mean"),
                F.round(F.stddev_samp(d), 4).alias("std"),
                F.lit(num).alias("is_numeric"),
            ).alias(f"c{len(parts)}")
        )
    wide = df.agg(*parts)
    long = wide.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(parts))])).alias("p")).select("p.*")
    each = [df.select(_col(c).alias("v")).where("v is not null").groupBy("v").agg(F.lit(1).alias("one")).agg(F.lit(c).alias("_column"), F.count("*").alias("n_unique")) for c in df.columns]
    unique = reduce(DataFrame.unionByName, each)  # a row a column
    long = long.join(F.broadcast(unique), F.col("name") == F.col("_column")).select("name", "dtype", "n_unique", *[c for c in long.columns if c not in ("name", "dtype")])
    out = long.withColumn("is_categorical", ~F.col("is_numeric") | (F.col("n_unique") < 15))
    if not samples:
        return out
    names = df.columns

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[] for _ in names]
        for batch in batches:
            for i, column in enumerate(batch.columns):
                # binary, so that order is by UTF-8 as the engine's is
                fresh = pc.unique(column.cast(pa.binary())).drop_null()
                at = pc.select_k_unstable(fresh, samples, [("", "ascending")]) if len(fresh) > samples else None
                held[i] = sorted({*held[i], *(fresh if at is None else fresh.take(at)).to_pylist()})[:samples]
        rows = [(n, v.decode()) for n, values in zip(names, held, strict=True) for v in values]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string())], ["_name", "v"])

    # some values a column and task
    found = df.select(*[_col(c).cast("string").alias(f"_{i}") for i, c in enumerate(names)]).mapInArrow(least, "_name string, v string")
    found = found.groupBy("_name").agg(F.slice(F.array_sort(F.collect_set("v")), 1, samples).alias("sample_values"))
    return out.join(found, out["name"] == found["_name"], "left").drop("_name").withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """AG2: a, b, r, n of all pairs, over rows that have both, from one pass of sums by the pattern of what rows lack; r is null where either is constant."""
    from assaygrid.operators.screening import complete, gram

    g = gram(df, columns)
    rows = []
    for a, b in combinations(columns, 2):
        m = complete(g, [a, b])
        n = m[0, 0]
        c = m[1:, 1:] - (m[1:, :1] @ m[:1, 1:]) / n if n else m[1:, 1:]
        spread = float(c[0, 0] * c[1, 1])
        flat = n < 2 or c[0, 0] <= 1e-12 * n or c[1, 1] <= 1e-12 * n
        rows.append((a, b, None if flat else float(c[0, 1]) / spread**0.5, int(round(n))))
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double, n long")


def correlation_with_outcome(df: DataFrame, features: list[str], outcome: str, least: int = 3) -> DataFrame:
    """AG3, TK13: feature, r and importance_rank by |r|; features with fewer than least joint rows have no r and rank last."""
    rows = [F.struct(F.lit(c).alias("feature"), safe_corr(_col(c), _col(outcome)).alias("r"), F.count_if(_col(c).isNotNull() & _col(outcome).isNotNull()).alias("n")).alias(f"p{i}") for i, c in enumerate(features)]
    long = df.agg(*rows).select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(features))])).alias("p")).select("p.*")
    long = long.withColumn("r", F.when(F.col("n") >= least, F.col("r")))
    return long.withColumn("importance_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(F.abs("r")), "feature")))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """AG4-AG7: a row for each column: n, skewness, kurtosis (population, excess), outlier_count by 1.5 IQR, distribution, transform.

    distribution: normal if D'Agostino's K2 does not reject at 0.05, else skewed, heavy_tailed or non_normal.
    """
    first = df.agg(*[F.struct(F.lit(c).alias("name"), F.count(_col(c)).alias("n"), F.skewness(_col(c)).alias("skew"), F.kurtosis(_col(c)).alias("kurt"), F.min(_col(c)).cast("double").alias("low")).alias(f"m{i}") for i, c in enumerate(columns)])
    stats = first.select(F.explode(F.array(*[F.col(f"m{i}") for i in range(len(columns))])).alias("p")).select("p.*").collect()  # a row a column
    fences = {c: (q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0])) if q[0] is not None else (None, None) for c, q in exact_quantiles(df, columns, [0.25, 0.75]).items()}
    counts = df.agg(*[F.count_if((_col(c) < F.lit(fences[c][0])) | (_col(c) > F.lit(fences[c][1]))).alias(c) for c in columns]).first()
    from assaygrid.functions.stats import normal_test

    rows = []
    for r in stats:
        n, s, k, low = r["n"], r["skew"], r["kurt"], r["low"]
        p = normal_test(n, s, k)[1] if n >= 20 and s is not None and k is not None else None
        kind = None if s is None else "normal" if p is not None and p > 0.05 else "skewed" if abs(s) > 1.5 else "heavy_tailed" if k > 3 else "non_normal"
        how = "none" if s is None or low is None else "log" if low > 0 and abs(s) > 1.5 else "sqrt" if low >= 0 and abs(s) > 0.8 else "none"
        rows.append((r["name"], n, s, k, p, int(counts[r["name"]] or 0), kind, how))
    return df.sparkSession.createDataFrame(rows, "name string, n long, skewness double, kurtosis double, normal_p double, outlier_count long, distribution string, transform string")


def panel_shape(df: DataFrame, entity: str, time: str | None = None) -> DataFrame:
    """AG9, AG10: one row: n_entities, least, most and mean rows an entity, balanced, median_timepoints."""
    per = df.groupBy(_col(entity)).agg(F.count("*").alias("n"), (F.count_distinct(_col(time)) if time else F.lit(None).cast("long")).alias("t"))
    middle = exact_quantiles(per, ["t"], [0.5])["t"][0] if time else None
    return per.agg(
        F.count("*").alias("n_entities"),
        F.min("n").alias("min_obs"),
        F.max("n").alias("max_obs"),
        F.avg("n").alias("mean_obs"),
        (F.min("n") == F.max("n")).alias("balanced"),
        F.lit(middle).cast("double").alias("median_timepoints"),
    )


def range_violations(df: DataFrame, outcome: str | None = None) -> DataFrame:
    """RD11: column, rule and n of values outside the range that the column's name tells (soft)."""
    checks = []
    for f in df.schema.fields:
        if not isinstance(f.dataType, T.NumericType):
            continue
        low, high = next(((lo, hi) for word, lo, hi in RANGES if word in f.name.lower()), (None, None))
        if f.name == outcome:
            low, high = 0.0, 1.0
        if low is None:
            continue
        bad = _col(f.name) < F.lit(low)
        bad = bad | (_col(f.name) > F.lit(high)) if high is not None else bad
        checks.append(F.struct(F.lit(f.name).alias("column"), F.lit(f"[{low:g}, {'inf' if high is None else format(high, 'g')}]").alias("rule"), F.count_if(bad).alias("n")))
    if not checks:
        return df.sparkSession.createDataFrame([], "column string, rule string, n long")
    row = df.agg(*[c.alias(f"r{i}") for i, c in enumerate(checks)])
    return row.select(F.explode(F.array(*[F.col(f"r{i}") for i in range(len(checks))])).alias("p")).select("p.*").where("n > 0")


def validate(df: DataFrame, outcome: str, inputs: list[str], entity: str | None = None, time: str | None = None) -> DataFrame:
    """RD9, RD10, RD12: code, severity and message of each rule that the table breaks."""
    num = lambda c: _col(c).try_cast("double")
    parts = [F.count("*").alias("n"), F.count(_col(outcome)).alias("y"), F.count(num(outcome)).alias("y_num"), F.stddev_samp(num(outcome)).alias("y_std")]
    parts += [F.count(_col(c)).alias(f"has_{c}") for c in inputs] + [F.count_distinct(_col(c)).alias(f"distinct_{c}") for c in inputs]
    parts += [F.count_distinct(_col(entity)).alias("entities")] if entity else []
    parts += [F.count_if(_col(time).isNotNull() & num(time).isNull()).alias("bad_time")] if time else []
    r = df.agg(*parts).first()
    rows: list[tuple[str, str, str]] = []
    say = lambda code, severity, message: rows.append((code, severity, message))
    n = r["n"]
    if not inputs:
        say("NO_INPUT_PREDICTORS", "error", "no input column")
    if n < 5:
        say("INSUFFICIENT_DATA", "error", f"{n} rows")
    elif n < 20:
        say("FEW_ROWS", "warning", f"{n} rows")
    if r["y"] < n or r["y_num"] < r["y"]:
        say("OUTCOME_NOT_NUMERIC", "error", f"{n - r['y_num']} values of {outcome} are missing or no number")
    if (r["y_std"] or 0.0) < 1e-6:
        say("OUTCOME_CONSTANT", "error", outcome)
    for c in inputs:
        missing = 1 - r[f"has_{c}"] / n if n else 1.0
        if missing > 0.2:
            say("HIGH_MISSING" if missing > 0.5 else "MISSING", "warning", f"{c}: {100 * missing:.1f} %")
        if r[f"distinct_{c}"] <= 1:
            say("CONSTANT_INPUT", "warning", c)
    if entity and r["entities"] < 2:
        say("FEW_EXPERIMENTS", "warning", f"{r['entities']} values of {entity}")
    if time and n and r["bad_time"] / n > 0.1:
        say("TIME_NOT_NUMERIC", "warning", time)
    return df.sparkSession.createDataFrame(rows, "code string, severity string, message string")


def input_pool(df: DataFrame, columns: list[str]) -> list[str]:
    """FL1: columns with two or more distinct values and eight or more rows."""
    r = df.agg(*[F.count(_col(c)).alias(f"n_{c}") for c in columns], *[F.count_distinct(_col(c)).alias(f"d_{c}") for c in columns]).first()
    return [c for c in columns if r[f"n_{c}"] >= 8 and r[f"d_{c}"] >= 2]


def output_pool(df: DataFrame, columns: list[str]) -> list[str]:
    """FL2: columns with five or more values in half of the rows or more."""
    r = df.agg(F.count("*").alias("_all"), *[F.count(_col(c)).alias(c) for c in columns]).first()
    return [c for c in columns if r[c] >= 5 and 2 * r[c] >= r["_all"]]


def candidate_inputs(df: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    """RD8: columns that vary, and constant ones."""
    r = df.agg(*[F.count_distinct(_col(c)).alias(c) for c in columns]).first()
    return [c for c in columns if r[c] > 1], [c for c in columns if r[c] <= 1]


def detect_entity(profiled: list[dict], configured: str | None = None) -> str | None:
    """RD14: the configured column, else the first whose name tells of an id and that varies."""
    names = [p["name"] for p in profiled]
    if configured in names:
        return configured
    return next((p["name"] for p in profiled if any(w in p["name"].lower() for w in ID_WORDS) and p["n_unique"] > 1), None)


def detect_time(profiled: list[dict], strategy: str = "name") -> str | None:
    """RD15: a datetime column first, then a numeric one named for time ("numeric3": with three or more values)."""
    stamps = [p["name"] for p in profiled if p["dtype"].startswith(("timestamp", "date"))]
    if stamps:
        return stamps[0]
    least = 3 if strategy == "numeric3" else 2
    return next((p["name"] for p in profiled if p["is_numeric"] and p["n_unique"] >= least and any(w in p["name"].lower() for w in TIME_WORDS)), None)


def infer_features(columns: list[str], outcome: str) -> list[str]:
    """RD16: columns other than the outcome, ids and times."""
    return [c for c in columns if c != outcome and not any(w in c.lower().split("_") for w in (*ID_WORDS, *TIME_WORDS))]


def value_counts(df: DataFrame, columns: list[str], top: int = 80) -> DataFrame:
    """AG18: column, value, n and rank of each column's most frequent values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _col(c).cast("string").alias("value")) for c in columns])).alias("p")).select("p.*").where("value is not null")
    counted = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value")))
    return ranked.where(F.col("rank") <= top)


def regime_column_stats(df: DataFrame, regime: str, columns: list[str]) -> DataFrame:
    """AG19: regime, column, n_distinct, is_constant."""
    kinds = dict(df.dtypes)
    wide = df.groupBy(_col(regime).alias("regime")).agg(*[F.count_distinct(_col(c)).alias(f"d{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(columns)])
    return wide.select("regime", F.explode(rows).alias("p")).select("regime", "p.*").withColumn("is_constant", F.col("n_distinct") <= 1)


def segment_summary(df: DataFrame, regime: str, row_id: str, condition: str, indexes: int = 40, values: int = 25) -> DataFrame:
    """AG20: rows, least row ids and least condition values of each segment; the lists are bounded before they are collected."""
    key = _col(regime).alias("regime")
    rows = df.groupBy(key).agg(F.count("*").alias("n_rows"))
    ids = df.select(key, _col(row_id).alias("v")).withColumn("r", F.row_number().over(Window.partitionBy("regime").orderBy("v"))).where(F.col("r") <= indexes).groupBy("regime").agg(F.array_sort(F.collect_list("v")).alias("index_sample"))
    conditions = df.select(key, _col(condition).alias("v")).where("v is not null").distinct().withColumn("r", F.row_number().over(Window.partitionBy("regime").orderBy("v"))).where(F.col("r") <= values).groupBy("regime").agg(F.array_sort(F.collect_list("v")).alias("condition_sample"))
    return rows.join(ids, "regime", "left").join(conditions, "regime", "left")


def resolve_outcome(columns: list[str], configured: str | None, override: str | None = None) -> str:
    """RD13: the column of the outcome's name, by its letters and digits alone; ValueError where there is none."""
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
    wanted = override or configured or ""
    found = [c for c in columns if plain(c) == plain(wanted)]
    if not wanted or not found:
        raise ValueError(f"no column for the outcome {wanted!r}")
    return found[0]
