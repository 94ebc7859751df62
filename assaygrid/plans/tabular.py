"""Queries over experiment tables: profiles, cleaning, panels, screening, diagnostics."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.operators import clean, models, order, panel, profile, quantiles, screening
from assaygrid.plans.registry import query, table



def r6(c, digits: int = 6):
    """Rounded for comparison, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, day (hours since the first of 2024), c1..c5 (counts of each type), total (value)."""
    e = table(spark, sf_dir, "events").withColumn("day", (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 24.0))
    types = [F.count_if(F.col("event_type") == t).cast("double").alias(f"c{i}") for i, t in enumerate(event_types(spark, sf_dir), 1)]
    return e.groupBy("user_id", "day").agg(*types, F.sum("value").alias("total"))


def event_types(spark: SparkSession, sf_dir: str) -> list[str]:
    """The event types by name: a fixed domain of five values, which the columns c1..c5 stand for."""
    found = [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").limit(6).collect()]
    if len(found) > 5:
        raise ValueError("events of more than five types; c1..c5 would leave some out")
    return found


DAILY = """
WITH kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)),
daily AS (SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS DOUBLE) * 24 AS day,
  CAST(count(*) FILTER (WHERE k = 1) AS DOUBLE) AS c1, CAST(count(*) FILTER (WHERE k = 2) AS DOUBLE) AS c2, CAST(count(*) FILTER (WHERE k = 3) AS DOUBLE) AS c3,
  CAST(count(*) FILTER (WHERE k = 4) AS DOUBLE) AS c4, CAST(count(*) FILTER (WHERE k = 5) AS DOUBLE) AS c5, sum(value) AS total
  FROM events JOIN kinds USING (event_type) GROUP BY user_id, day)
"""


@query("""
WITH long AS (SELECT l_returnflag AS regime, unnest(['l_quantity', 'l_discount', 'l_tax']) AS predictor, unnest([l_quantity, l_discount, l_tax]) AS x, l_extendedprice AS y FROM lineitem),
fits AS (SELECT regime, predictor, CAST(regr_count(y, x) AS BIGINT) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM long GROUP BY 1, 2)
SELECT regime, predictor, n, round(slope, 4) + 0.0 AS slope, round(intercept, 4) + 0.0 AS intercept, round(r2, 6) + 0.0 AS r_squared
FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY r2 DESC, predictor) AS k FROM fits) WHERE k = 1
""")
def univariate_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single predictor that best explains price, for each return flag."""
    from pyspark.sql import Window

    names = ("l_quantity", "l_discount", "l_tax")
    l = table(spark, sf_dir, "lineitem")
    long = l.select(F.col("l_returnflag").alias("regime"), F.explode(F.array(*[F.struct(F.lit(c).alias("predictor"), F.col(c).alias("x")) for c in names])).alias("p"), F.col("l_extendedprice").alias("y")).select("regime", "p.*", "y")
    fits = long.groupBy("regime", "predictor").agg(F.regr_count("y", "x").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))
    best = fits.withColumn("k", F.row_number().over(Window.partitionBy("regime").orderBy(F.desc("r2"), "predictor"))).where("k = 1")
    return best.select("regime", "predictor", "n", r6(F.col("slope"), 4).alias("slope"), r6(F.col("intercept"), 4).alias("intercept"), r6(F.col("r2")).alias("r_squared"))


_QUANTILES = {"l_quantity": 0.5, "l_extendedprice": 0.25, "l_discount": 0.9, "l_tax": 0.333, "l_orderkey": 0.75}


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, CAST({p} AS DOUBLE) AS p, round(quantile_cont(CAST({c} AS DOUBLE), {p}), 6) + 0.0 AS value FROM lineitem" for c in _QUANTILES for p in sorted({0.5, *_QUANTILES.values()})))
def column_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of five columns from the same passes."""
    asked = sorted({0.5, *_QUANTILES.values()})
    found = quantiles.exact_quantiles(table(spark, sf_dir, "lineitem"), list(_QUANTILES), asked)
    return spark.createDataFrame([(c, p, round(v, 6) + 0.0) for c, vs in found.items() for p, v in zip(asked, vs, strict=True)], "name string, p double, value double")


_PROFILED = ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS n_missing, round(100.0 * (count(*) - count({c})) / count(*), 2) + 0.0 AS missing_pct, "
        + (f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) + 0.0 AS mean, round(stddev_samp({c}), 4) + 0.0 AS std, TRUE AS is_numeric, count(DISTINCT {c}) < 15 AS is_categorical" if i < 4 else "NULL AS min, NULL AS max, NULL AS mean, NULL AS std, FALSE AS is_numeric, TRUE AS is_categorical")
        + " FROM lineitem"
        for i, c in enumerate(_PROFILED)
    )
)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(table(spark, sf_dir, "lineitem").select(*_PROFILED), samples=0).drop("dtype")


def _with_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.select("l_orderkey", F.when(F.col("l_tax") == 0, "ND").when(F.col("l_tax") == 0.01, " - ").otherwise(F.col("l_tax").cast("string")).alias("tax"))


@query("SELECT l_orderkey, CASE WHEN l_tax = 0 OR l_tax = 0.01 THEN NULL ELSE l_tax END AS tax FROM lineitem")
def placeholder_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.coerce_placeholders(_with_placeholders(spark, sf_dir))


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS o_orderpriority FROM orders")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded, _ = clean.label_encode(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])
    return encoded.select("o_orderkey", "o_orderpriority")


@query("SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS class, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def label_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.label_dictionary(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("SELECT * FROM (VALUES ('event_type', 'string'), ('stamp', 'timestamp'), ('text_value', 'double')) t(name, kind)")
def type_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("string").alias("stamp"), F.col("value").cast("string").alias("text_value"))
    return spark.createDataFrame(sorted(clean.sniff_types(e).items()), "name string, kind string")


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("l_tax"), F.when(F.col("l_discount") > 0.06, F.col("l_discount")).alias("l_discount"))


for _how, _sql in (("median", "median"), ("mean", "avg"), ("mode", None)):
    _value = f"SELECT {_sql}(x)" if _sql else "SELECT x"
    _tail = "" if _sql else " GROUP BY x ORDER BY count(*) DESC, x LIMIT 1"

    def _impute(spark: SparkSession, sf_dir: str, how: str = _how) -> DataFrame:
        return clean.impute(_gappy(spark, sf_dir), ["l_tax"], how).select("l_orderkey", r6(F.col("l_tax")).alias("l_tax"))

    _impute.__name__ = f"impute_{_how}"
    query(f"WITH g AS (SELECT l_orderkey, nullif(l_tax, 0) AS x FROM lineitem), v AS ({_value} AS x FROM g WHERE x IS NOT NULL{_tail}) SELECT l_orderkey, round(coalesce(g.x, v.x), 6) + 0.0 AS l_tax FROM g, v")(_impute)


@query("SELECT l_orderkey, nullif(l_tax, 0) AS l_tax FROM lineitem")
def drop_high_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_high_missing(_gappy(spark, sf_dir).withColumn("l_discount", F.when(F.col("l_discount") > 0.08, F.col("l_discount"))), ["l_tax", "l_discount"])


@query("SELECT p_partkey, round(p_retailprice * 1e-3, 9) + 0.0 AS conc_ug_l FROM part")
def unit_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("conc_ug_l"))
    return clean.scale_units(p, {"conc_ug_l": "ug_l"}).select("p_partkey", r6(F.col("conc_ug_l"), 9).alias("conc_ug_l"))


@query("""
WITH d AS (SELECT p_partkey, exp(p_size / 8.0) AS dose FROM part), m AS (SELECT avg(dose) AS a, stddev_pop(dose) AS s FROM d),
k AS (SELECT avg(((dose - a) / s) ** 3) AS skew FROM d, m)
SELECT p_partkey, round(dose, 6) + 0.0 AS dose, CASE WHEN abs(skew) > 1.5 THEN round(ln(dose), 6) + 0.0 END AS dose_log FROM d, k
""")
def log_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select("p_partkey", F.exp(F.col("p_size") / 8.0).alias("dose"))
    out = clean.log_features(d, ["dose"])
    return out.select("p_partkey", r6(F.col("dose")).alias("dose"), r6(F.col("dose_log")).alias("dose_log"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'N' AS INTEGER) AS \"l_returnflag_N\", CAST(l_returnflag = 'R' AS INTEGER) AS \"l_returnflag_R\" FROM lineitem")
def onehot_drop_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.one_hot(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 6) + 0.0 AS l_quantity_x_l_discount FROM lineitem")
def interaction_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean.interaction(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount")
    return out.select("l_orderkey", "l_linenumber", r6(F.col("l_quantity_x_l_discount")).alias("l_quantity_x_l_discount"))


@query("WITH m AS (SELECT avg(p_retailprice) AS a, stddev_pop(p_retailprice) AS s FROM part) SELECT p_partkey, round((p_retailprice - a) / s, 6) + 0.0 AS z FROM part, m")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.standardize(table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("z")), ["z"]).select("p_partkey", r6(F.col("z")).alias("z"))


@query("""
SELECT 'ph' AS "column", '[0, 14]' AS rule, count(*) FILTER (WHERE l_quantity < 0 OR l_quantity > 14) AS n FROM lineitem
UNION ALL SELECT 'temperature_c', '[-10, 100]', count(*) FILTER (WHERE l_extendedprice < -10 OR l_extendedprice > 100) FROM lineitem
UNION ALL SELECT 'y', '[0, 1]', count(*) FILTER (WHERE l_linenumber > 1) FROM lineitem
""")
def range_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("ph"), F.col("l_extendedprice").alias("temperature_c"), F.col("l_tax").alias("dose"), F.col("l_linenumber").cast("double").alias("y"))
    return profile.range_violations(l, "y")


@query("""
SELECT 'HIGH_MISSING' AS code, 'warning' AS severity, 'l_discount: ' || printf('%.1f', 100.0 * count(*) FILTER (WHERE l_discount <= 0.06) / count(*)) || ' %' AS message FROM lineitem
UNION ALL SELECT 'CONSTANT_INPUT', 'warning', 'one'
""")
def validation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", F.when(F.col("l_discount") > 0.06, F.col("l_discount")).alias("l_discount"), F.lit(1.0).alias("one"))
    return profile.validate(l, "l_extendedprice", ["l_discount", "one"], entity="l_orderkey")


_JOINED = "SELECT l_quantity, l_discount, l_tax, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, l_extendedprice, l_extendedprice / 1000 + l_quantity + p_retailprice / 20 + p_size AS response FROM lineitem JOIN part ON p_partkey = l_partkey"
_INPUTS = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]


def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return l.join(p, l["l_partkey"] == p["p_partkey"]).select("l_orderkey", "l_linenumber", "l_returnflag", *[F.col(c).cast("double").alias(c) for c in (*_INPUTS, "l_extendedprice")]).withColumn("response", F.col("l_extendedprice") / 1000 + F.col("l_quantity") + F.col("p_retailprice") / 20 + F.col("p_size"))


def in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """experiment with row_id: 0, 1, 2 ... by order and line."""
    return order.numbered(experiment(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"], "row_id")


@query(
    f"WITH e AS ({_JOINED}) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r, count(*) AS n FROM e" for i, a in enumerate(_INPUTS) for b in _INPUTS[i + 1 :])
)
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.correlations(experiment(spark, sf_dir), _INPUTS).select("a", "b", r6(F.col("r")).alias("r"), "n")


@query(
    f"WITH e AS ({_JOINED}), c AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS feature, corr({a}, response) AS r FROM e" for a in _INPUTS)
    + ") SELECT feature, round(r, 6) + 0.0 AS r, CAST(row_number() OVER (ORDER BY abs(r) DESC, feature) AS INTEGER) AS importance_rank FROM c"
)
def corr_with_outcome_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.correlation_with_outcome(experiment(spark, sf_dir), _INPUTS, "response").select("feature", r6(F.col("r")).alias("r"), "importance_rank")


_MOMENT = """SELECT '{c}' AS name, count({c}) AS n, round(sum(({c} - a) ** 3) / count({c}) / s ** 3, 5) + 0.0 AS skewness, round(sum(({c} - a) ** 4) / count({c}) / s ** 4 - 3, 5) + 0.0 AS kurtosis,
count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count
FROM lineitem, (SELECT avg({c}) AS a, stddev_pop({c}) AS s, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem) GROUP BY a, s"""


@query(" UNION ALL ".join(_MOMENT.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_tax")))
def skew_kurtosis_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = profile.moments(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return m.select("name", "n", r6(F.col("skewness"), 5).alias("skewness"), r6(F.col("kurtosis"), 5).alias("kurtosis"), "outlier_count")


@query("""
WITH v AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_tax']) AS name, unnest([l_quantity, l_extendedprice, l_tax]) AS x FROM lineitem), c AS (SELECT name, avg(x) AS m, stddev_pop(x) AS s, min(x) AS low FROM v GROUP BY 1),
k AS (SELECT name, avg(((x - m) / s) ** 3) AS skew, avg(((x - m) / s) ** 4) - 3 AS kurt, min(low) AS low FROM v JOIN c USING (name) GROUP BY 1)
SELECT name, CASE WHEN abs(skew) > 1.5 THEN 'skewed' WHEN kurt > 3 THEN 'heavy_tailed' ELSE 'non_normal' END AS distribution, CASE WHEN low > 0 AND abs(skew) > 1.5 THEN 'log' WHEN low >= 0 AND abs(skew) > 0.8 THEN 'sqrt' ELSE 'none' END AS transform FROM k
""")
def distribution_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """None of these columns is normal by D'Agostino's test at any scale; tests hold the test itself."""
    return profile.moments(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]).select("name", "distribution", "transform")


@query("""
WITH k AS (SELECT p_partkey, coalesce(p_type, '__NA__') AS t, coalesce(CAST(p_size AS VARCHAR), '__NA__') AS s FROM part),
f AS (SELECT t, s, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS id FROM k GROUP BY t, s)
SELECT p_partkey, id AS _derived_entity_id FROM k JOIN f USING (t, s)
""")
def derived_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.derive_entity(table(spark, sf_dir, "part"), ["p_type", "p_size"], "p_partkey").select("p_partkey", "_derived_entity_id")


_SPLIT = """SELECT '{c}' AS "column", round(var_samp({c} - m) / var_samp({c}), 5) + 0.0 AS within_fraction,
CASE WHEN var_samp({c} - m) / var_samp({c}) < 0.05 THEN 'between_entity' ELSE 'within_varying' END AS class FROM (SELECT {c}, avg({c}) OVER (PARTITION BY user_id) AS m FROM e)"""


@query(
    "WITH e AS (SELECT user_id, value, CAST(event_id AS DOUBLE) AS event_no, CAST(user_id * 2 AS DOUBLE) AS user_no FROM events) "
    + " UNION ALL ".join(_SPLIT.format(c=c) for c in ("value", "event_no", "user_no"))
)
def within_between_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "value", F.col("event_id").cast("double").alias("event_no"), (F.col("user_id") * 2).cast("double").alias("user_no"))
    return panel.split_predictors(e, ["value", "event_no", "user_no"], "user_id").withColumn("within_fraction", r6(F.col("within_fraction"), 5))


@query("""
WITH m AS (SELECT *, avg(value) OVER (PARTITION BY user_id) AS m FROM events),
b AS (SELECT var_samp(m) AS between_var FROM (SELECT user_id, avg(value) AS m FROM events GROUP BY 1)),
w AS (SELECT var_samp(value - m) AS within_var, var_samp(m) / var_samp(value) AS icc FROM m)
SELECT round(within_var, 4) + 0.0 AS within_var, round(between_var, 4) + 0.0 AS between_var, round(icc, 6) + 0.0 AS icc, CASE WHEN within_var / between_var > 0.3 THEN 'fixed' ELSE 'random' END AS effects FROM w, b
""")
def panel_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = panel.variance_split(table(spark, sf_dir, "events"), "value", "user_id")
    return v.select(r6(F.col("within_var"), 4).alias("within_var"), r6(F.col("between_var"), 4).alias("between_var"), r6(F.col("icc")).alias("icc"), "effects")


@query(DAILY + "SELECT count(*) AS n_entities, min(n) AS min_obs, max(n) AS max_obs, round(avg(n), 6) + 0.0 AS mean_obs, min(n) = max(n) AS balanced, median(t) + 0.0 AS median_timepoints FROM (SELECT user_id, count(*) AS n, count(DISTINCT day) AS t FROM daily GROUP BY 1)")
def balanced_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.panel_shape(daily(spark, sf_dir), "user_id", "day").withColumn("mean_obs", r6(F.col("mean_obs")))


_H = "-(" + " + ".join(f"CASE WHEN c{i} > 0 THEN c{i} / s * ln(c{i} / s) ELSE 0 END" for i in range(1, 6)) + ")"


@query(DAILY + f"SELECT user_id, day, round({_H}, 6) + 0.0 AS entropy FROM (SELECT *, c1 + c2 + c3 + c4 + c5 AS s FROM daily)")
def shannon_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.entropy(daily(spark, sf_dir), [f"c{i}" for i in range(1, 6)]).select("user_id", "day", r6(F.col("entropy")).alias("entropy"))


_Q = ", ".join(f"first(c{i}) OVER w AS q{i}" for i in range(1, 6))
_KL = " + ".join(f"(c{i} / s + 1e-12) / z * ln((c{i} / s + 1e-12) / (q{i} / q + 1e-12))" for i in range(1, 6))


@query(
    DAILY
    + f", f AS (SELECT *, {_Q} FROM daily WINDOW w AS (PARTITION BY user_id ORDER BY day)), g AS (SELECT *, c1 + c2 + c3 + c4 + c5 AS s, q1 + q2 + q3 + q4 + q5 AS q, 1 + 5e-12 AS z FROM f) "
    + f"SELECT user_id, day, round(greatest(0, {_KL}), 4) + 0.0 AS kl FROM g"
)
def kl_from_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = panel.kl_from_initial(daily(spark, sf_dir), [f"c{i}" for i in range(1, 6)], "user_id", "day", "total")
    return out.select("user_id", "day", r6(F.col("kl"), 4).alias("kl"))


@query(DAILY + f", t AS (SELECT day, {', '.join(f'avg(c{i}) AS c{i}' for i in range(1, 6))} FROM daily GROUP BY day), h AS (SELECT day, {_H} AS h FROM (SELECT *, c1 + c2 + c3 + c4 + c5 AS s FROM t)) SELECT day AS time, round(h, 6) + 0.0 AS entropy FROM h ORDER BY h DESC, day LIMIT 1")
def inflection_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.inflection(daily(spark, sf_dir), [f"c{i}" for i in range(1, 6)], "day").withColumn("entropy", r6(F.col("entropy")))


@query(
    DAILY
    + """, r AS (SELECT user_id, day, c1 + 1 AS c, first(c1 + 1) OVER (PARTITION BY user_id ORDER BY day) AS c0 FROM daily),
f AS (SELECT user_id AS entity, count(*) AS n, regr_slope(ln(c / c0), day) AS b, regr_r2(ln(c / c0), day) AS r2, regr_sxx(ln(c / c0), day) AS sxx, regr_syy(ln(c / c0), day) AS syy FROM r GROUP BY 1)
SELECT entity, n, round(-b, 6) + 0.0 AS k, round(ln(2) / -b, 2) + 0.0 AS half_life, round(sqrt((1 - r2) * syy / ((n - 2) * sxx)), 6) + 0.0 AS se FROM f WHERE n >= 3 AND sxx > 0 AND b < 0"""
)
def rate_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).withColumn("c", F.col("c1") + 1)
    return panel.rate_constants(d, "c", "user_id", "day", "total").select("entity", "n", "k", "half_life", "se")


def _means(i: int, way: str) -> str:
    return f"(SELECT avg(c{i}) FROM (SELECT c{i} FROM daily ORDER BY day {way}, user_id {way} LIMIT 3))"


@query(DAILY + " UNION ALL ".join(f"SELECT 'c{i}' AS \"column\", (SELECT count(*) FROM daily) AS n, round({_means(i, 'ASC')}, 6) + 0.0 AS head, round({_means(i, 'DESC')}, 6) + 0.0 AS tail" for i in range(1, 6)))
def head_tail_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.head_tail_means(daily(spark, sf_dir), [f"c{i}" for i in range(1, 6)], ["day", "user_id"]).select("column", "n", r6(F.col("head")).alias("head"), r6(F.col("tail")).alias("tail"))


@query(DAILY + ", m AS (" + " UNION ALL ".join(f"SELECT 'c{i}' AS \"column\", ({_means(i, 'ASC')} - {_means(i, 'DESC')}) / ({_means(i, 'ASC')} + 1e-9) AS d" for i in range(1, 6)) + ') SELECT "column", round(d, 6) + 0.0 AS "drop" FROM m ORDER BY d DESC, "column" LIMIT 1')
def parent_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.parent_component(daily(spark, sf_dir), [f"c{i}" for i in range(1, 6)], ["day", "user_id"]).select("column", r6(F.col("drop")).alias("drop"))


@query(DAILY + "SELECT user_id AS entity, round(sum(a), 4) + 0.0 AS auc, count(*) AS n FROM (SELECT user_id, (day - lag(day) OVER w) * (total + lag(total) OVER w) / 2 AS a FROM daily WINDOW w AS (PARTITION BY user_id ORDER BY day, total)) GROUP BY 1 HAVING count(*) >= 2")
def auc_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.auc(daily(spark, sf_dir), "total", "user_id", "day").withColumn("auc", r6(F.col("auc"), 4))


@query(
    DAILY
    + """, a AS (SELECT user_id, sum(a) AS auc FROM (SELECT user_id, (day - lag(day) OVER w) * (total + lag(total) OVER w) / 2 AS a FROM daily WINDOW w AS (PARTITION BY user_id ORDER BY day, total)) GROUP BY 1),
x AS (SELECT user_id, first(c1 ORDER BY day) AS c1 FROM daily GROUP BY 1)
SELECT round(regr_slope(auc, c1), 2) + 0.0 AS slope, round(regr_r2(auc, c1), 6) + 0.0 AS r_squared, count(*) AS n FROM a JOIN x USING (user_id)"""
)
def two_stage_treatment(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = panel.two_stage_treatment(daily(spark, sf_dir), "total", "user_id", "day", ["c1"], "day")
    return frame.agg(r6(F.regr_slope("auc", "c1"), 2).alias("slope"), r6(F.regr_r2("auc", "c1")).alias("r_squared"), F.count("*").alias("n"))


@query(f"""
WITH e AS ({_JOINED}), s AS (SELECT count(*) AS n, regr_sxx(response, l_quantity) AS aa, regr_sxx(response, p_retailprice) AS bb, regr_sxy(p_retailprice, l_quantity) AS ab,
  regr_sxy(response, l_quantity) AS ay, regr_sxy(response, p_retailprice) AS by_, regr_syy(response, l_quantity) AS yy FROM e),
b AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS b1, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM s)
SELECT n, round(b1, 4) + 0.0 AS b_quantity, round(b2, 4) + 0.0 AS b_price, round((b1 * ay + b2 * by_) / yy, 6) + 0.0 AS r_squared, round(1 / (1 - ab * ab / (aa * bb)), 6) + 0.0 AS vif FROM b
""")
def bivariate_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = screening.gram(experiment(spark, sf_dir), ["l_quantity", "p_retailprice", "response"])
    f = screening.solve(g, "response", ("l_quantity", "p_retailprice"))
    row = (f.n, round(f.coefficients["l_quantity"], 4), round(f.coefficients["p_retailprice"], 4), round(f.r_squared, 6), round(f.max_vif, 6))
    return spark.createDataFrame([row], "n long, b_quantity double, b_price double, r_squared double, vif double")


_PAIRS = [(a, b) for i, a in enumerate(_INPUTS) for b in _INPUTS[i + 1 :]]


@query(
    f"WITH e AS ({_JOINED}), c AS (SELECT "
    + ", ".join(f"corr({a}, response) AS y_{a}" for a in _INPUTS)
    + ", "
    + ", ".join(f"corr({a}, {b}) AS r_{a}_{b}" for a, b in _PAIRS)
    + " FROM e), m AS ("
    + " UNION ALL ".join([f"SELECT '{a}' AS x, y_{a} ** 2 AS r2 FROM c" for a in _INPUTS] + [f"SELECT '{a},{b}', (y_{a} ** 2 + y_{b} ** 2 - 2 * y_{a} * y_{b} * r_{a}_{b}) / (1 - r_{a}_{b} ** 2) FROM c" for a, b in _PAIRS])
    + ") SELECT x, round(r2, 5) + 0.0 AS r_squared FROM m WHERE r2 >= 0.06"
)
def batch_ols_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of one and two inputs from one Gram pass."""
    g = screening.gram(experiment(spark, sf_dir), [*_INPUTS, "response"])
    found = screening.candidates(_INPUTS, ["response"], sizes=(1, 2))
    fits = [f for c in found if not screening.correlated(g, c.x) and (f := screening.solve(g, c.y, c.x)) and f.r_squared >= screening.MIN_R2]
    return spark.createDataFrame([(",".join(f.x), round(f.r_squared, 5)) for f in fits], "x string, r_squared double")


@query()
def quota_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The screening engine end to end: candidates with time (discount's stand-in), Gram pass, residual pass, balanced quotas."""
    e = in_order(spark, sf_dir)
    return screening.screen(e, ["l_quantity", "l_tax", "p_size", "p_retailprice"], ["response"], "row_id", time="l_discount")


@query()
def regime_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = in_order(spark, sf_dir)
    return screening.screen(e, ["l_quantity", "l_tax", "p_size", "p_retailprice"], ["response"], "row_id", regime="l_returnflag")


@query("SELECT round(regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 1), 6) + 0.0 AS slope FROM lineitem")
def ridge_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = screening.gram(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([(round(screening.solve(g, "l_extendedprice", ("l_quantity",), ridge=1.0).coefficients["l_quantity"], 6),)], "slope double")


@query(
    DAILY
    + """, w AS (SELECT user_id, total - avg(total) OVER (PARTITION BY user_id) AS y, day - avg(day) OVER (PARTITION BY user_id) AS x FROM daily),
s AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, sum(y * y) AS yy, count(DISTINCT user_id) AS g, count(*) AS n FROM w),
m AS (SELECT sum(u * u) AS meat FROM (SELECT user_id, sum(x * (y - b * x)) AS u FROM w, s GROUP BY 1))
SELECT n, g AS n_entities, round(b, 6) + 0.0 AS slope, round(sqrt(meat * g / (g - 1.0)) / xx, 6) + 0.0 AS clustered_se, round(b * b * xx / yy, 6) + 0.0 AS within_r2 FROM s, m"""
)
def fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = models.fixed_effects(daily(spark, sf_dir), "total", ["day"], "user_id")
    return spark.createDataFrame([(f.n, f.n_entities, round(f.coefficients["day"], 6), round(f.clustered_se["day"], 6), round(f.within_r2, 6))], "n long, n_entities long, slope double, clustered_se double, within_r2 double")


@query()
def hausman(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    fe, re = models.fixed_effects(d, "total", ["day"], "user_id"), models.random_effects(d, "total", ["day"], "user_id")
    found = models.hausman(fe, re) or (None, None)
    return spark.createDataFrame([(fe.coefficients["day"], re.coefficients["day"], *found)], "fe double, re double, statistic double, p double")


_RESIDUALS = """
WITH o AS (SELECT o_orderkey AS k, CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM orders), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx FROM o),
e AS (SELECT k, y, a + b * x AS fit, y - a - b * x AS e, 1.0 / n + (x - mx) ** 2 / sxx AS h, n FROM o, f), v AS (SELECT sum(e * e) / (count(*) - 2) AS s2, avg(e) AS me, stddev_pop(e) AS se, regr_r2(e * e, fit) AS bp FROM e),
d AS (SELECT *, lag(e) OVER (ORDER BY k) AS p FROM e)
"""


@query(
    _RESIDUALS
    + """SELECT max(d.n) AS n, round(sum((e - p) ** 2) / sum(e * e), 6) + 0.0 AS durbin_watson, round(sqrt(avg(e * e)), 4) + 0.0 AS rmse, round(avg(abs(e)), 4) + 0.0 AS mae,
round(max(e * e / (2 * s2) * h / (1 - h) ** 2), 8) + 0.0 AS max_cooks_d, count(*) FILTER (WHERE e * e / (2 * s2) * h / (1 - h) ** 2 > 4.0 / d.n) AS n_influential,
round(max(d.n) / 6.0 * (avg(((e - me) / se) ** 3) ** 2 + (avg(((e - me) / se) ** 4) - 3) ** 2 / 4), 3) + 0.0 AS jarque_bera, round(max(bp), 8) + 0.0 AS bp_lite_r2 FROM d, v"""
)
def residual_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    fit = screening.solve(screening.gram(o, ["x", "y"]), "y", ("x",))
    t = screening.residual_tests(o, [fit], "o_orderkey")[0]
    row = (t["n"], round(t["durbin_watson"], 6), round(t["rmse"], 4), round(t["mae"], 4), round(t["max_cooks_d"], 8), t["n_influential"], round(t["jarque_bera"], 3), round(t["bp_lite_r2"], 8))
    return spark.createDataFrame([row], "n long, durbin_watson double, rmse double, mae double, max_cooks_d double, n_influential long, jarque_bera double, bp_lite_r2 double")


@query()
def specification_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breusch-Pagan and RESET of price on quantity and retail price."""
    e = experiment(spark, sf_dir)
    fit = screening.solve(screening.gram(e, ["l_quantity", "p_retailprice", "response"]), "response", ("l_quantity", "p_retailprice"))
    t = screening.auxiliary_tests(e, fit)
    return spark.createDataFrame([(t["breusch_pagan_p"], t["reset_p"])], "breusch_pagan_p double, reset_p double")


@query("""
WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) * count(*) AS w FROM lineitem GROUP BY 1),
t AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(w) AS w, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS b FROM g)
SELECT k AS n_groups, n, round(b / (k - 1) / (w / (n - k)), 4) + 0.0 AS f, round(b / (b + w), 8) + 0.0 AS eta_squared FROM t
""")
def anova_eta2(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = models.anova(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag")
    return a.select("n_groups", "n", r6(F.col("f"), 4).alias("f"), r6(F.col("eta_squared"), 8).alias("eta_squared"))


@query("""
WITH o AS (SELECT CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y, ntile(5) OVER (ORDER BY o_orderkey) AS f FROM orders),
b AS (SELECT k, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE f <> k GROUP BY k)
SELECT CAST(k AS INTEGER) AS fold, round(1 - sum((y - a - b * x) ** 2) / (var_pop(y) * count(*)), 6) + 0.0 AS r_squared FROM o JOIN b ON f = k GROUP BY k
""")
def kfold_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(screening.kfold_r2(o, "y", ("x",), "o_orderkey"), 1)], "fold int, r_squared double")


@query("SELECT round((0.28 + 0.22 + 0.13) / (0.28 + 0.22 + 0.22 + 0.13), 4) AS ols, round((0.35 * 0.5 + 0.2 * 1 + 0.25 * 0.4 + 0.15 * 1 + 0.05 * 0.8) / 1.0, 4) AS panel")
def diagnostic_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(screening.composite(0.3, 2.0, 7.0, None, 0.2), screening.panel_composite(0.5, 0.6, 0.2, 0.01, 8))], "ols double, panel double")


@query("SELECT l_returnflag AS regime, unnest(['l_quantity', 'l_linestatus']) AS \"column\", unnest(['double', 'string']) AS dtype, unnest([count(DISTINCT l_quantity), count(DISTINCT l_linestatus)]) AS n_distinct, unnest([count(DISTINCT l_quantity) <= 1, count(DISTINCT l_linestatus) <= 1]) AS is_constant FROM lineitem GROUP BY 1")
def regime_column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.regime_column_stats(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_linestatus"])


@query("""
SELECT o_orderstatus AS regime, count(*) AS n_rows, array_to_string(list_slice(list(o_orderkey ORDER BY o_orderkey), 1, 40), ',') AS index_sample,
array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS condition_sample FROM orders GROUP BY 1
""")
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = profile.segment_summary(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey", "o_orderpriority")
    return s.select("regime", "n_rows", F.array_join(F.col("index_sample").cast("array<string>"), ",").alias("index_sample"), F.array_join("condition_sample", ",").alias("condition_sample"))


@query("""
WITH c AS (SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank FROM c) WHERE rank <= 80
""")
def value_counts_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query()
def lasso_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = in_order(spark, sf_dir)
    f = models.lasso_cv(e, "response", _INPUTS, "row_id")
    return spark.createDataFrame([(f["alpha"], f["nonzero"], f["sparsity"], f["cv_r2"], f["coefficients"])], "alpha double, nonzero int, sparsity double, cv_r2 double, coefficients map<string,double>")


@query()
def ridge_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = in_order(spark, sf_dir)
    f = models.ridge_cv(e, "response", _INPUTS, "row_id")
    return spark.createDataFrame([(f["alpha"], f["effective_df"], f["shrinkage"], f["condition"], f["cv_r2"])], "alpha double, effective_df double, shrinkage double, condition double, cv_r2 double")


@query()
def elastic_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = models.elastic_net(experiment(spark, sf_dir), "response", _INPUTS)
    return spark.createDataFrame([(f["intercept"], f["r_squared"], f["coefficients"])], "intercept double, r_squared double, coefficients map<string,double>")


@query()
def tree_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = experiment(spark, sf_dir)
    rows = []
    for kind in ("forest", "gbt"):
        f = models.tree_model(e, "response", _INPUTS, kind)
        rows.append((kind, f["r_squared"], f["cv_r2"], f["gap"], models.tree_score(f["gap"], f["cv_r2"]), f["importances"]))
    return spark.createDataFrame(rows, "kind string, r_squared double, cv_r2 double, gap double, score double, importances map<string,double>")


@query()
def grouped_fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).withColumn("week", F.floor(F.col("day") / 168))
    f = models.grouped_fixed_effects(d, "total", ["c1", "c2"], "user_id", "week", starts=1)
    return spark.createDataFrame([(f["k"], f["bic"], f["sse"], f["coefficients"])], "k int, bic double, sse double, coefficients map<string,double>")


@query()
def mixture_of_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = models.mixture(daily(spark, sf_dir), "total", ["c1", "c2"], "day")
    return spark.createDataFrame([(f["k"], f["bic"], f["log_likelihood"], f["weights"])], "k int, bic double, log_likelihood double, weights array<double>")


@query()
def stationarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.stationarity(daily(spark, sf_dir), ["total", "c1"], "user_id", ["user_id", "day"])


@query()
def shapiro_wilk(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = models.shapiro_test(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey")
    return spark.createDataFrame([(f["n"], f["w"], f["p"])], "n int, w double, p double")


