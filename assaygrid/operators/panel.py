"""Panel operators and derived metrics (PN, WN): entities, compositions, decay rates, areas, splits of variance."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaygrid.functions.stats import t_sf2
from assaygrid.operators.order import numbered

#: What a missing input counts as in a derived entity.
MISSING = "__NA__"
# Names of composition columns, with "_" and "-" taken out.
COMPOSITION = (r"^c(\d{1,2})$", r"^(?:conc|concentration)c?(\d{1,2})$", r"^(?:species|analyte|component|compound|fraction)(\d{1,2})$")


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def derive_entity(df: DataFrame, inputs: list[str], row_id: str, name: str = "_derived_entity_id") -> DataFrame:
    """PN1: df with a dense id of the tuple of inputs, numbered by first appearance in row_id order; nulls equal each other."""
    key = F.struct(*[F.coalesce(_col(c).cast("string"), F.lit(MISSING)).alias(f"k{i}") for i, c in enumerate(inputs)])
    keyed = df.withColumn("_key", key)
    firsts = keyed.groupBy("_key").agg(F.min(row_id).alias("_first"))
    ids = numbered(firsts, ["_first"], name).select(F.col("_key").alias("_k"), name)
    return keyed.drop(*[c for c in df.columns if c == name]).join(ids, F.col("_key") == F.col("_k")).drop("_key", "_k")


def demean(df: DataFrame, columns: list[str], entity: str) -> DataFrame:
    """WN1, JN9: columns less their entity's mean, as c_within."""
    over = Window.partitionBy(_col(entity))
    return df.withColumns({f"{c}_within": _col(c) - F.avg(_col(c)).over(over) for c in columns})


def split_predictors(df: DataFrame, columns: list[str], entity: str, least: float = 0.05) -> DataFrame:
    """PN4, FL8: column, within_fraction and class (constant, between_entity, within_varying) of each column; one window, one aggregate."""
    both = demean(df, columns, entity)
    parts = [F.struct(F.lit(c).alias("column"), F.count_distinct(_col(c)).alias("n"), F.var_samp(_col(c)).alias("total"), F.var_samp(_col(f"{c}_within")).alias("within")).alias(f"p{i}") for i, c in enumerate(columns)]
    long = both.agg(*parts).select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(columns))])).alias("p")).select("p.*")
    constant = (F.col("n") <= 1) | (F.coalesce("total", F.lit(0.0)) < 1e-6)
    fraction = F.when(~constant, F.try_divide("within", "total"))
    return long.select("column", fraction.alias("within_fraction"), F.when(constant, "constant").when(fraction < least, "between_entity").otherwise("within_varying").alias("class"))


def variance_split(df: DataFrame, outcome: str, entity: str) -> DataFrame:
    """AG8, PN3, DG11: one row: within_var, between_var (of entity means), icc, ratio and the recommended effects."""
    over = Window.partitionBy(_col(entity))
    mean = df.where(_col(outcome).isNotNull()).withColumn("_m", F.avg(_col(outcome)).over(over)).withColumn("_first", F.row_number().over(over.orderBy(_col(outcome))) == 1)
    r = mean.agg(
        F.var_samp(_col(outcome) - F.col("_m")).alias("within_var"),
        F.var_samp(F.when(F.col("_first"), F.col("_m"))).alias("between_var"),
        F.try_divide(F.var_samp("_m"), F.var_samp(_col(outcome))).alias("icc"),
    )
    ratio = F.try_divide("within_var", "between_var")
    return r.withColumn("ratio", ratio).withColumn("effects", F.when(ratio > 0.3, "fixed").otherwise("random"))


def composition_columns(columns: list[str]) -> list[str]:
    """PN5: columns that hold parts of a composition, by their index."""
    found = []
    for c in columns:
        m = next((m for p in COMPOSITION if (m := re.match(p, re.sub(r"[_-]", "", c.lower())))), None)
        if m:
            found.append((int(m[1]), c))
    return [c for _, c in sorted(found)]


def _vector(columns: list[str]) -> Column:
    return F.array(*[F.greatest(F.coalesce(_col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns])


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def entropy_of(v: Column) -> Column:
    """PN7: Shannon's entropy of a vector of amounts; 0 where they sum to 0."""
    total = _total(v)
    return F.aggregate(v, F.lit(0.0), lambda s, x: s - F.when((x > 0) & (total > 0), x / total * F.ln(x / total)).otherwise(0.0))


def entropy(df: DataFrame, columns: list[str], name: str = "entropy") -> DataFrame:
    return df.withColumn(name, entropy_of(_vector(columns)))


def _beside_first(df: DataFrame, value: Column, entity: str, time: str, row_id: str, name: str) -> DataFrame:
    """df with the value of each entity's first row in order of time: one aggregate and a join, so that rows of a large entity stay where they are."""
    firsts = df.where(_col(entity).isNotNull()).groupBy(_col(entity).alias("_e")).agg(F.min_by(value, F.struct(_col(time), _col(row_id))).alias(name))
    return df.join(firsts, _col(entity) == F.col("_e"), "left").drop("_e")


def kl_from_initial(df: DataFrame, columns: list[str], entity: str, time: str, row_id: str, name: str = "kl") -> DataFrame:
    """PN8: Kullback-Leibler divergence from the entity's first composition, with 1e-12 added to shares; 0 without an entity."""
    tiny = 1e-12

    def shares(v: Column) -> Column:
        total = _total(v)
        raised = F.transform(v, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)) + tiny)
        return F.transform(raised, lambda x: x / (1 + tiny * len(columns) - F.when(total > 0, 0.0).otherwise(1.0)))

    kl = F.aggregate(F.zip_with(shares(_vector(columns)), shares(F.col("_q")), lambda p, q: p * F.ln(p / q)), F.lit(0.0), lambda s, x: s + x)
    begun = _beside_first(df, _vector(columns), entity, time, row_id, "_q")
    return begun.withColumn(name, F.when(_col(entity).isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), kl))).drop("_q")


def rate_constants(df: DataFrame, column: str, entity: str, time: str, row_id: str) -> DataFrame:
    """PN9: entity, n, k, r_squared, half_life, t99, se, p_value of a first-order decay ln(C / C0) on time, where it decays.

    C0 is the entity's first value in order of time, which must be 1e-12 or more; three or more rows; k > 0. Rows without
    an entity, a value or a time take no part. p_value is that of the slope, two-sided.

    Whether a slope that is zero but for rounding falls, and to which side a half-life on a tie is rounded, hangs on the order of
    sums. So an entity's rows are summed one after the other in order of time, as SQL reads them: one shuffle and sort of
    three numbers a row, and a task holds one entity's sums at a time.
    """
    rows = df.where(_col(column).isNotNull() & _col(time).isNotNull() & _col(entity).isNotNull())
    rows = rows.select(_col(entity).alias("entity"), _col(time).alias("_time"), _col(row_id).alias("_row"), _col(time).cast("double").alias("t"), _col(column).cast("double").alias("c"))
    kind = rows.schema["entity"].dataType.simpleString()
    fit = rows.repartition("entity").sortWithinPartitions("entity", "_time", "_row").select("entity", "t", "c").mapInArrow(_in_order, f"entity {kind}, n long, tl double, tt double, ll double")
    good = fit.where((F.col("n") >= 3) & (F.col("tt") > 0)).withColumn("k", -F.try_divide("tl", "tt")).where("k > 0")
    corr = F.try_divide(F.col("tl"), F.sqrt("tt") * F.sqrt("ll"))
    r2, k, n = F.coalesce(corr * corr, F.lit(1.0)), F.col("k"), F.col("n")
    se = F.sqrt(F.greatest(F.lit(0.0), (1 - r2) * (F.col("ll") * n) / ((n - 2) * (F.col("tt") * n))))
    return good.select(
        "entity",
        "n",
        _rounded(k, 6).alias("k"),
        _rounded(r2, 4).alias("r_squared"),
        _rounded(F.lit(math.log(2)) / k, 2).alias("half_life"),
        _rounded(F.lit(math.log(100)) / k, 2).alias("t99"),
        _rounded(se, 6).alias("se"),
        _rounded(F.when(se > 0, _two_sided(F.try_divide(k, se), n - 2)).otherwise(0.0), 6).alias("p_value"),
    )


def _rounded(x: Column, digits: int) -> Column:
    """Half away from zero of the scaled double, as SQL engines in C do; F.round looks at the decimal digits, which lie on a tie more often."""
    scale = F.lit(10.0**digits)
    return F.round(x * scale) / scale


def _product_and_sum(a: float, b: float, c: float) -> float:
    """a * b + c, rounded once."""
    try:
        return math.fma(a, b, c)
    except (ValueError, OverflowError):  # values that are not finite
        return a * b + c


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (entity, t, c) by entity and time: n, covariance of time and ln(C / C0), and their variances, each summed row by row."""
    now, n, first = None, 0, 0.0
    t_mean = l_mean = tl = tt = ll = 0.0
    for batch in batches:
        kind, out = batch.schema.field(0).type, []
        for entity, t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if entity != now:
                if n:
                    out.append((now, n, tl / n, tt / n, ll / n))
                now, n, first = entity, 0, c
                t_mean = l_mean = tl = tt = ll = 0.0
            if not first >= 1e-12:
                continue
            n += 1
            v = math.log(max(c / first, 1e-12))
            t_was, l_was = t - t_mean, v - l_mean
            t_mean, l_mean = t_mean + t_was / n, l_mean + l_was / n
            tl, tt, ll = _product_and_sum(t_was, v - l_mean, tl), tt + (t - t_mean) * t_was, ll + (v - l_mean) * l_was
        if out:
            yield _fits(out, kind)
    if n:
        yield _fits([(now, n, tl / n, tt / n, ll / n)], kind)


def _fits(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), *[pa.float64()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["entity", "n", "tl", "tt", "ll"])


@F.arrow_udf(T.DoubleType())
def _two_sided(t: pa.Array, df: pa.Array) -> pa.Array:
    pairs = zip(t.to_pylist(), df.to_pylist(), strict=True)
    return pa.array([None if a is None or b is None else t_sf2(a, b) for a, b in pairs], pa.float64())


def head_tail_means(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """WN5: column, n, top (the greatest value), head and tail: means of the first and last three values in order.

    All columns share the scans: one aggregate, and three rows a column from each end, which Spark picks in tasks before it shuffles them.
    """
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _col(c).cast("double").alias("v")) for c in columns])).alias("x")
    long = df.select(values, *[_col(o).alias(f"_o{i}") for i, o in enumerate(order)]).select("x.*", *[f"_o{i}" for i in range(len(order))]).where("v is not null")

    def end(name: str, way) -> DataFrame:
        over = Window.partitionBy("column").orderBy(*[way(f"_o{i}") for i in range(len(order))])
        return long.withColumn("_n", F.row_number().over(over)).where("_n <= 3").groupBy("column").agg(F.avg("v").alias(name))

    counts = long.groupBy("column").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    out = every.join(counts, "column", "left").join(end("head", F.asc), "column", "left").join(end("tail", F.desc), "column", "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0))).select("column", "n", "top", "head", "tail")


def parent_component(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """PN6: the component that falls most from its head to its tail mean, relative to the head; four or more values, some of 0.01 or more."""
    drop = (F.col("head") - F.col("tail")) / (F.col("head") + 1e-9)
    able = head_tail_means(df, columns, order).where("n >= 4 and top >= 0.01").withColumn("drop", drop)
    return able.orderBy(F.desc("drop"), "column").limit(1).select("column", "drop")


def inflection(df: DataFrame, columns: list[str], time: str) -> DataFrame:
    """PN12: the time at which the mean composition's entropy is highest (of equals the first), given four or more times."""
    per = df.where(_col(time).isNotNull()).groupBy(_col(time).alias("time")).agg(*[F.avg(_col(c)).alias(c) for c in columns])
    h = per.select("time", entropy_of(_vector(columns)).alias("entropy"))
    enough = h.agg(F.count("*").alias("n"))
    best = h.orderBy(F.desc("entropy"), "time").limit(1)
    return best.crossJoin(enough).where("n >= 4").select("time", "entropy")  # one row each


def auc(df: DataFrame, column: str, entity: str, time: str) -> DataFrame:
    """WN4: entity, auc and n of the trapezoids in order of time and value; two or more points."""
    rows = df.where(_col(column).isNotNull() & _col(time).isNotNull()).select(_col(entity).alias("entity"), _col(time).cast("double").alias("t"), _col(column).cast("double").alias("y"))
    over = Window.partitionBy("entity").orderBy("t", "y")
    area = (F.col("t") - F.lag("t").over(over)) * (F.col("y") + F.lag("y").over(over)) / 2
    return rows.withColumn("a", area).groupBy("entity").agg(F.sum("a").alias("auc"), F.count("*").alias("n")).where("n >= 2")


def first_values(df: DataFrame, columns: list[str], entity: str, row_id: str) -> DataFrame:
    """WN2, WN3: entity and each column's first value that is not null."""
    return df.groupBy(_col(entity).alias("entity")).agg(*[F.min_by(_col(c), F.when(_col(c).isNotNull(), _col(row_id))).alias(c) for c in columns])


def two_stage_treatment(df: DataFrame, outcome: str, entity: str, time: str, features: list[str], row_id: str) -> DataFrame:
    """MD13's frame: entity, auc and the between-entity features that every entity has, or four fifths of them."""
    frame = auc(df, outcome, entity, time).join(first_values(df, features, entity, row_id), "entity")
    share = frame.agg(*[F.avg(_col(c).isNotNull().cast("int")).alias(c) for c in features]).first()
    dense = [c for c in features if share[c] == 1.0] or [c for c in features if (share[c] or 0) >= 0.8]
    return frame.select("entity", "auc", *dense)


def active_outputs(df: DataFrame, columns: list[str], least: float = 0.1) -> DataFrame:
    """PN11: columns of which more than a tenth of the values is above zero and which vary."""
    parts = [F.struct(F.lit(c).alias("column"), F.avg((_col(c) > 0).cast("int")).alias("positive"), F.var_samp(_col(c)).alias("variance")).alias(f"p{i}") for i, c in enumerate(columns)]
    long = df.agg(*parts).select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(columns))])).alias("p")).select("p.*")
    return long.where((F.col("positive") > least) & (F.col("variance") > 1e-6))


def modelable_outputs(df: DataFrame, outcome: str, columns: list[str], parent: str | None = None, time: str | None = None, is_panel: bool = False) -> DataFrame:
    """PN11: what can be modelled: name, kind, approach, sources, n_nonzero, variance; from one aggregate.

    The outcome and the sum of three or more components are listed if more than a tenth of all rows is above zero and they
    vary by more than 1e-6. Entropy and, given a time, divergence follow from three or more components; a rate from a
    parent in a panel. These derived ones are not computed here: they count as every row, of variance 1.
    """
    has = len(columns) >= 3
    total = sum((F.coalesce(_col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))
    regression = "panel_regression" if is_panel else "cross_sectional"
    strings = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")

    def row(name: str, kind: str, approach: str, sources: list[str], nonzero: Column, variance: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(approach).alias("approach"), strings(sources).alias("sources"), nonzero.alias("n_nonzero"), variance.alias("variance"))

    every, one = F.count("*"), F.lit(1.0)
    measured = [("outcome", _col(outcome).cast("double"))] if outcome in df.columns else []
    measured += [("total", total)] if has else []
    found = [row(outcome if kind == "outcome" else "total_composition_concentration", {"outcome": "direct"}.get(kind, "derived_total"), regression, [outcome] if kind == "outcome" else columns, F.count_if(v > 0), F.var_samp(v)) for kind, v in measured]
    derived = [row("shannon_entropy", "derived_entropy", regression, columns, every, one)] if has else []
    derived += [row("kl_divergence", "derived_kl", regression, columns, every, one)] if has and time else []
    derived += [row("degradation_rate_k", "derived_rate", "first_order_decay", [parent, time], every, one)] if parent and time and is_panel else []
    if not found + derived:
        return df.limit(0).select(F.explode(F.array(row("", "", "", [], F.lit(0).cast("long"), one))).alias("p")).select("p.*")
    parts = [p.alias(f"p{i}") for i, p in enumerate(found + derived)]
    long = df.agg(every.alias("_n"), *parts).select("_n", F.explode(F.array(*[F.col(f"p{i}") for i in range(len(parts))])).alias("p")).select("_n", "p.*")
    active = (F.col("n_nonzero") > F.col("_n") * 0.1) & (F.col("variance") > 1e-6)
    return long.where(~F.col("kind").isin("direct", "derived_total") | active).drop("_n")


def augment(df: DataFrame, columns: list[str], entity: str, time: str, row_id: str) -> DataFrame:
    """PN10: entropy and divergence if there are three or more components, and the parent's rate."""
    if len(columns) >= 3:
        df = kl_from_initial(entropy(df, columns, "metric_entropy"), columns, entity, time, row_id, "metric_kl")
    parent = parent_component(df, columns, [time, row_id]).first() if columns else None
    if parent is not None:
        rates = rate_constants(df, parent["column"], entity, time, row_id).select(F.col("entity").alias("_e"), F.col("k").alias("metric_rate"))
        df = df.join(rates, _col(entity).eqNullSafe(F.col("_e")), "left").drop("_e")
    return df


def group_label(n: Column) -> Column:
    """PN15."""
    return F.when(n >= 3, "composition").when(n >= 1, "species").otherwise("response")


def detect(df: DataFrame, inputs: list[str], features: list[str], time: str | None, row_id: str) -> dict:
    """PN13: what a table is: entities derived from its inputs, panel, times, composition with its parent and inflection, kinds of predictors, active outputs."""
    placed = derive_entity(df, inputs, row_id)
    entity = "_derived_entity_id"
    r = placed.agg(F.count_distinct(entity).alias("e"), F.count("*").alias("n"), *([F.count_distinct(_col(time)).alias("t")] if time else [])).first()
    parts = composition_columns(df.columns)
    index = {c: int(re.search(r"\d+$", c)[0]) for c in parts}
    middle = (min(index.values()) + max(index.values())) / 2 if parts else 0
    series = len(parts) >= 2
    kinds = {s["column"]: s["class"] for s in split_predictors(placed, features, entity).collect()}  # a row a column
    parent = parent_component(df, parts, [time or row_id, row_id]).first() if series else None
    turn = inflection(df, parts, time).first() if series and time else None
    return {
        "n_rows": r["n"],
        "n_entities": r["e"],
        "n_timepoints": r["t"] if time else 1,
        "is_panel": bool(time) and r["n"] > r["e"] and r["t"] >= 2,
        "composition": parts,
        "has_high_index": any(i > middle for i in index.values()),
        "has_low_index": any(i <= middle for i in index.values()),
        "parent": parent["column"] if parent else None,
        "inflection": turn["time"] if turn else None,
        "predictors": kinds,
        "active_outputs": sorted(a["column"] for a in active_outputs(df, parts).collect()) if series else [],
    }


def time_structure(within: DataFrame, significant: DataFrame, top: int = 5) -> DataFrame:
    """PN14: of (output, within_r2) and (output, time) one row: time_explains_pct (mean within R2 in percent, one digit) and the top times that are significant most often, in order of time."""
    share = within.agg(F.round(F.coalesce(F.avg("within_r2"), F.lit(0.0)) * 100, 1).alias("time_explains_pct"))
    often = significant.groupBy("time").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "time").limit(top)
    return share.join(F.broadcast(often.agg(F.array_sort(F.collect_list("time")).alias("dominant_times"))))  # one row each
