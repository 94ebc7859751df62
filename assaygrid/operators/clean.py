"""Cleaning and encoding (PJ): missing stays missing, columns are cast only when every value agrees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaygrid.operators.order import numbered
from assaygrid.operators.quantiles import exact_quantiles

# Cells that mean "missing", compared trimmed and without case.
PLACEHOLDERS = (
    "-", "--", "---", "na", "n/a", "n.a.", "nan", "none", "null", "nd", "n.d.", "nr", "n.r.", "bdl", "bl", "<dl", "<bdl", "not detected", "not measured",
)
#: What a number looks like; keeps casts from taking "1.5d", "inf" or "nan" for one.
NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"
UNIT_FACTORS = {"ug_l": 1e-3, "ng_l": 1e-6, "nm": 1e-6, "um": 1e-3}
LOG_HINTS = ("concentration", "dose", "rate", "flux", "intensity")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def number(c: Column) -> Column:
    """A string as a double where it reads as a plain number, else null."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def is_placeholder(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*PLACEHOLDERS)


def drop_empty(df: DataFrame) -> DataFrame:
    """PJ1: without rows and columns that are all null, in one pass for the columns."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c]]).na.drop("all")


def trim_strings(df: DataFrame) -> DataFrame:
    """PJ2."""
    return df.withColumns({c: F.trim(F.col(f"`{c}`")) for c in string_columns(df)})


def coerce_placeholders(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """PJ4: string columns whose every value is a number or a placeholder become double, placeholders null; constant columns stay."""
    names = columns or string_columns(df)
    if not names:
        return df
    checks = df.agg(
        *[F.count_if(F.col(f"`{c}`").isNotNull() & ~is_placeholder(F.col(f"`{c}`")) & number(F.col(f"`{c}`")).isNull()).alias(f"bad_{i}") for i, c in enumerate(names)],
        *[F.count_distinct(F.col(f"`{c}`")).alias(f"n_{i}") for i, c in enumerate(names)],
        *[F.count(number(F.col(f"`{c}`"))).alias(f"num_{i}") for i, c in enumerate(names)],
    ).first()
    good = [c for i, c in enumerate(names) if checks[f"bad_{i}"] == 0 and checks[f"n_{i}"] > 1 and checks[f"num_{i}"] > 0]
    return df.withColumns({c: F.when(~is_placeholder(F.col(f"`{c}`")), number(F.col(f"`{c}`"))) for c in good})


def sniff_types(df: DataFrame) -> dict[str, str]:
    """PJ3: for each string column timestamp, double or string: the first that all its values read as."""
    names = string_columns(df)
    if not names:
        return {}
    exprs = []
    for i, c in enumerate(names):
        x = F.col(f"`{c}`")
        exprs += [F.count(x).alias(f"n{i}"), F.count(F.try_to_timestamp(x)).alias(f"t{i}"), F.count(number(x)).alias(f"d{i}")]
    r = df.agg(*exprs).first()
    return {c: "timestamp" if r[f"n{i}"] and r[f"t{i}"] == r[f"n{i}"] and r[f"d{i}"] < r[f"n{i}"] else "double" if r[f"n{i}"] and r[f"d{i}"] == r[f"n{i}"] else "string" for i, c in enumerate(names)}


def apply_types(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    cast = {"timestamp": lambda x: F.try_to_timestamp(x), "double": number}
    return df.withColumns({c: cast[k](F.col(f"`{c}`")) for c, k in kinds.items() if k in cast})


def label_dictionary(df: DataFrame, column: str, nan_as_category: bool = False) -> DataFrame:
    """PJ6: (column, class, code) of a column's distinct strings in codepoint order."""
    value = F.col(f"`{column}`").cast("string")
    values = df.select((F.coalesce(value, F.lit("nan")) if nan_as_category else value).alias("class")).where("class is not null").distinct()
    return numbered(values, ["class"], "code").select(F.lit(column).alias("column"), "class", F.col("code").cast("double").alias("code"))


def label_encode(df: DataFrame, columns: list[str], nan_as_category: bool = False) -> tuple[DataFrame, DataFrame]:
    """PJ5: columns as codes 0..k-1, and their dictionary. Dictionaries are joined; Spark broadcasts those it finds small."""
    dictionary = None
    for c in columns:
        d = label_dictionary(df, c, nan_as_category)
        dictionary = d if dictionary is None else dictionary.unionByName(d)
        value = F.col(f"`{c}`").cast("string")
        codes = d.select(F.col("class").alias("_class"), F.col("code").alias("_code"))
        key = F.coalesce(value, F.lit("nan")) if nan_as_category else value
        df = df.join(codes, key == F.col("_class"), "left").withColumn(c, F.col("_code")).drop("_class", "_code")
    return df, dictionary


def missing_rates(df: DataFrame, columns: list[str]) -> dict[str, float]:
    r = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(c) for c in columns]).first()
    return {c: 1 - r[c] / r["n"] if r["n"] else 1.0 for c in columns}


def drop_high_missing(df: DataFrame, columns: list[str], most: float = 0.5) -> DataFrame:
    """PJ9."""
    return df.drop(*[c for c, r in missing_rates(df, columns).items() if r > most])


def impute(df: DataFrame, columns: list[str], how: str = "median") -> DataFrame:
    """PJ10: nulls of numeric columns by exact median (quantiles.py), mean, or mode (of equally frequent values the least), of all columns at once."""
    if how == "mode":
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)])).alias("s")
        counts = df.select(each).select("s.c", "s.v").where("v is not null").groupBy("c", "v").count()
        values = {columns[r["c"]]: r["v"] for r in counts.groupBy("c").agg(F.max_by("v", F.struct("count", -F.col("v"))).alias("v")).collect()}  # a row a column
    elif how == "median":
        values = {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()}
    else:
        r = df.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in columns]).first()
        values = {c: r[c] for c in columns}
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(v))) for c, v in values.items() if v is not None})


def log_features(df: DataFrame, columns: list[str], least_skew: float = 1.5) -> DataFrame:
    """PJ12: c_log for columns whose names hint at amounts, all above zero and skewed."""
    named = [c for c in columns if any(h in c.lower() for h in LOG_HINTS)]
    if not named:
        return df
    r = df.agg(*[F.min(F.col(f"`{c}`")).alias(f"min_{c}") for c in named], *[F.skewness(F.col(f"`{c}`")).alias(f"skew_{c}") for c in named]).first()
    return df.withColumns({f"{c}_log": F.ln(F.col(f"`{c}`")) for c in named if (r[f"min_{c}"] or 0) > 0 and abs(r[f"skew_{c}"] or 0) > least_skew})


def scale_units(df: DataFrame, units: dict[str, str]) -> DataFrame:
    """PJ13: columns in ug_l, ng_l, nm or um in their base unit."""
    return df.withColumns({c: F.col(f"`{c}`") * F.lit(UNIT_FACTORS[u]) for c, u in units.items() if u in UNIT_FACTORS})


def one_hot(df: DataFrame, column: str, most: int = 1000) -> DataFrame:
    """PJ15: 0/1 columns c_value for all but the first of a column's sorted values. Nulls: all 0. More than most values raise."""
    distinct = df.select(column).where(F.col(f"`{column}`").isNotNull()).distinct()
    values = sorted(r[0] for r in distinct.limit(most + 1).collect())
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values, each of which would be a column")
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(f"`{column}`") == F.lit(v)).cast("int"), F.lit(0)) for v in values[1:]}).drop(column)


def transform_feature(df: DataFrame, column: str, how: str) -> DataFrame:
    """PJ16: log if all values are above zero, sqrt if none is below; else unchanged."""
    low = df.agg(F.min(F.col(f"`{column}`")).alias("m")).first()["m"]
    if low is not None and (how == "log" and low > 0 or how == "sqrt" and low >= 0):
        return df.withColumn(column, {"log": F.ln, "sqrt": F.sqrt}[how](F.col(f"`{column}`")))
    return df


def interaction(df: DataFrame, a: str, b: str) -> DataFrame:
    """PJ17: the product a_x_b."""
    return df.withColumn(f"{a}_x_{b}", F.col(f"`{a}`") * F.col(f"`{b}`"))


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """PJ18: z-scores with the population deviation; a deviation of zero counts as one."""
    r = df.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m_{c}") for c in columns], *[F.stddev_pop(F.col(f"`{c}`")).alias(f"s_{c}") for c in columns]).first()
    return df.withColumns({c: (F.col(f"`{c}`") - F.lit(r[f"m_{c}"])) / F.lit(r[f"s_{c}"] or 1.0) for c in columns})


def factorize(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """PJ19: c_code, numbered by first appearance; nulls stay null."""
    firsts = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("_v")).agg(F.min(row_id).alias("_first"))
    codes = numbered(firsts, ["_first"], "_n").select("_v", F.col("_n").cast("double").alias(f"{column}_code"))
    return df.join(codes, F.col(f"`{column}`") == F.col("_v"), "left").drop("_v")


def capitalise_no(df: DataFrame, columns: list[str]) -> DataFrame:
    """PJ7: a cell that is exactly no becomes No."""
    return df.withColumns({c: F.when(F.col(f"`{c}`") == "no", "No").otherwise(F.col(f"`{c}`")) for c in columns})


def drop_missing_outcome(df: DataFrame, outcome: str) -> DataFrame:
    """PJ11: rows that have the outcome."""
    return df.where(F.col(f"`{outcome}`").isNotNull())


class Steps:
    """PJ14: a table under a chain of steps, with what each did to its rows and columns."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.log: list[tuple[str, DataFrame]] = [("read", df)]

    def then(self, name: str, step, *args) -> Steps:
        self.df = step(self.df, *args)
        self.log.append((name, self.df))
        return self

    def audit(self) -> DataFrame:
        """step (its number), name, n_rows and n_columns after it; each step's rows are counted."""
        parts = [df.agg(F.lit(i).alias("step"), F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")) for i, (name, df) in enumerate(self.log)]
        return reduce(DataFrame.unionByName, parts)
