"""Queries over rounds of models: dispatch, best of a round, diagnostics beyond the first, citations, bundles, panels, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.operators import clean, models, order, panel, profile, results, retrieval, screening
from assaygrid.operators import rounds as model_rounds
from assaygrid.plans.registry import query, table
from assaygrid.plans.served import _TOP, MODELS, _found, store
from assaygrid.plans.tabular import _JOINED, DAILY, daily, experiment, r6

CITED = MODELS + """, c AS (SELECT l_orderkey AS model_result_id, CAST(l_partkey % 7 AS VARCHAR) AS url, l_discount AS s, l_linenumber AS pos, l_partkey FROM lineitem)"""


@query(
    CITED
    + """, f AS (SELECT hypothesis_id, min(id) AS model_id, arg_min(r_squared, id) AS r_squared FROM m GROUP BY 1), n AS (SELECT model_result_id, count(*) AS n, max(s) AS s FROM c GROUP BY 1)
SELECT h.id AS hypothesis_id, f.model_id, round(f.r_squared, 6) + 0.0 AS r_squared, v.overall_passed AS validation_passed, coalesce(n.n, 0) AS n_citations, n.s AS best_similarity
FROM h LEFT JOIN f ON f.hypothesis_id = h.id LEFT JOIN v ON v.model_result_id = f.model_id LEFT JOIN n ON n.model_result_id = f.model_id WHERE run_id = '7'"""
)
def hypothesis_firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    out = results.firsts(s["hypotheses"], s["model_results"], s["validation_results"], s["citations"], "7")
    return out.select("hypothesis_id", "model_id", r6(F.col("r_squared")).alias("r_squared"), "validation_passed", "n_citations", "best_similarity")


@query(MODELS + "SELECT h.id AS hypothesis_id, coalesce(round(arg_min(match_score, m.id), 6), 0.0) + 0.0 AS score, CAST(count(m.id) > 0 AS INTEGER) AS n_keys FROM h LEFT JOIN m ON hypothesis_id = h.id GROUP BY 1")
def summary_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    grounding = s["model_results"].select("id", "hypothesis_id", F.create_map(F.lit("match"), F.col("match_score")).alias("grounding"))
    out = results.with_grounding(s["hypotheses"].select(F.col("id").alias("hypothesis_id")), grounding)
    return out.select("hypothesis_id", r6(F.coalesce(F.try_element_at("grounding", F.lit("match")), F.lit(0.0))).alias("score"), F.size("grounding").alias("n_keys"))


@query("""
WITH h AS (SELECT n_nationkey AS id, n_name AS label FROM nation), m AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN CAST(s_nationkey AS VARCHAR) WHEN 1 THEN (SELECT n_name FROM nation WHERE n_nationkey = s_nationkey) ELSE 'none' END AS hypothesis FROM supplier)
SELECT m.id, coalesce(a.id, b.id) AS hypothesis_id FROM m LEFT JOIN h a ON CAST(a.id AS VARCHAR) = hypothesis LEFT JOIN h b ON b.label = hypothesis
""")
def hypothesis_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % 3
    named = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.when(k == 0, F.col("s_nationkey").cast("string")).when(k == 1, F.col("n_name")).otherwise("none").alias("hypothesis"))
    return results.resolve(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")), named)


_FINDINGS = MODELS + ", g AS (SELECT round, h.id AS hypothesis_id, avg(match_score) AS m FROM h JOIN m ON hypothesis_id = h.id GROUP BY 1, 2)"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return s["hypotheses"].select(F.col("id").alias("hypothesis_id"), "round").join(s["model_results"].select("hypothesis_id", "match_score", F.col("id").alias("model_result_id")), "hypothesis_id")


@query(_FINDINGS + " SELECT hypothesis_id, round, round(m, 6) + 0.0 AS global_match, round(avg(m) OVER (PARTITION BY round), 6) + 0.0 AS round_match FROM g")
def finding_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.match_means(findings(spark, sf_dir)).select("hypothesis_id", "round", r6(F.col("global_match")).alias("global_match"), r6(F.col("round_match")).alias("round_match"))


@query(CITED + ", u AS (SELECT model_result_id, url, max(s) AS s FROM c GROUP BY 1, 2), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY model_result_id ORDER BY s DESC, url) AS INTEGER) AS rank FROM u) SELECT model_result_id, url, s AS similarity_score, rank FROM k WHERE rank <= 3")
def citations_distinct_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.distinct_citations(store(spark, sf_dir)["citations"], ["model_result_id"], 3).select("model_result_id", "url", "similarity_score", "rank")


@query("SELECT l_orderkey, CAST(l_partkey % 3 AS VARCHAR) AS url, arg_max(l_discount, l_linenumber * 1000 + l_discount) AS similarity_score FROM lineitem GROUP BY 1, 2")
def citations_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 3).cast("string").alias("url"), F.col("l_discount").alias("similarity_score"), (F.col("l_linenumber") * 1000 + F.col("l_discount")).alias("pos"))
    return results.last_by_url(l, ["l_orderkey"], "pos").drop("pos")


@query(
    _FINDINGS
    + """, c AS (SELECT DISTINCT h.round, l_partkey % 20 AS url FROM h JOIN m ON hypothesis_id = h.id JOIN lineitem ON l_orderkey = m.id)
SELECT round, round(avg(m), 4) + 0.0 AS global_match, count(*) AS n_hypotheses, (SELECT least(15, count(*)) FROM c WHERE c.round = g.round) AS n_citations, avg(m) >= 0.75 AS convergence_ready FROM g GROUP BY 1"""
)
def round_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("model_result_id"), (F.col("l_partkey") % 20).cast("string").alias("url"), F.col("l_discount").alias("similarity_score"))
    out = results.round_grounding(f, f.select("round", "model_result_id").join(l, "model_result_id"))
    return out.withColumn("global_match", r6(F.col("global_match"), 4))


@query(
    MODELS
    + """, n AS (SELECT hypothesis_id, count(*) AS n FROM m GROUP BY 1), r AS (SELECT run_id, count(DISTINCT round) AS n_rounds, count(*) AS n_hypotheses, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_models, count(n) AS n_fitted FROM h LEFT JOIN n ON hypothesis_id = h.id GROUP BY 1)
SELECT CAST(n_nationkey AS VARCHAR) AS id, coalesce(n_rounds, 0) AS n_rounds, coalesce(n_hypotheses, 0) AS n_hypotheses, coalesce(n_models, 0) AS n_models, coalesce(n_fitted, 0) AS n_fitted,
CASE WHEN coalesce(n_fitted, 0) = 0 THEN 'pending' WHEN n_fitted < n_hypotheses THEN 'running' ELSE 'completed' END AS status FROM nation LEFT JOIN r ON run_id = CAST(n_nationkey AS VARCHAR)"""
)
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return results.run_status(s["runs"], s["hypotheses"], s["model_results"])


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' AND nullif(o_orderkey % 4, 0) IS NULL")
def same_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("regime"), F.when(F.col("o_orderkey") % 4 != 0, "file").alias("filename"))
    return results.same_request(o, "2-HIGH", "F", None).select("o_orderkey")


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN n_name END AS value FROM nation")
def key_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys written as they are, as 007 for 7, and absent ones."""
    k = F.col("n_nationkey")
    key = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit("00"), k.cast("string"))).otherwise("none")
    return table(spark, sf_dir, "nation").select("n_nationkey", results.key_coalesce(F.create_map(k.cast("string"), F.col("n_name")), key).alias("value"))


@query("SELECT o_orderkey, 'price ' || CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 1000 > 0 THEN 'increases' ELSE 'decreases' END || ' ' || o_orderstatus || ' (coefficient=' || printf('%.4f', CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * (o_orderkey % 1000) / 8.0) || ')' AS finding FROM orders")
def finding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    b = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1) * (F.col("o_orderkey") % 1000) / 8.0
    return o.select("o_orderkey", results.finding_text(F.lit("price"), F.col("o_orderstatus"), b).alias("finding"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber - 1 >= greatest(1, l_linenumber + l_partkey % 3 - 1) AS overall FROM lineitem")
def validation_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", results.overall(n - 1, n + F.col("l_partkey") % 3).alias("overall"))


_BEST = MODELS + ", b AS (SELECT * FROM (SELECT hypothesis_id, m.id AS model_id, r_squared, coalesce(overall_passed, FALSE) AS passed, row_number() OVER (PARTITION BY hypothesis_id ORDER BY coalesce(overall_passed, FALSE) DESC, r_squared DESC, m.id) AS k FROM m LEFT JOIN v ON model_result_id = m.id WHERE m.id % 5 <> 0) WHERE k = 1)"


@query(_BEST + " SELECT hypothesis_id, model_id, round(r_squared, 6) + 0.0 AS r_squared, passed FROM b")
def best_of_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return results.best_of_round(s["model_results"].withColumn("success", F.col("id") % 5 != 0), s["validation_results"]).withColumn("r_squared", r6(F.col("r_squared")))


@query(_BEST + " SELECT run_id, round, count(*) AS n_hypotheses, count(*) FILTER (WHERE passed) AS n_passed, count(*) - count(*) FILTER (WHERE passed) AS n_failed, round(coalesce(max(r_squared), 0), 6) + 0.0 AS best_r_squared, round(count(*) FILTER (WHERE passed) / count(*), 6) + 0.0 AS pass_rate FROM h LEFT JOIN b ON hypothesis_id = h.id GROUP BY 1, 2")
def round_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    out = results.round_summary(s["hypotheses"], s["model_results"].withColumn("success", F.col("id") % 5 != 0), s["validation_results"])
    return out.withColumns({"best_r_squared": r6(F.col("best_r_squared")), "pass_rate": r6(F.col("pass_rate"))})


@query("""
WITH k AS (SELECT l_orderkey AS model, l_linenumber AS variable, l_extendedprice AS importance, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank, greatest(1, count(*) OVER (PARTITION BY l_orderkey) // 3) AS k FROM lineitem)
SELECT model, variable, importance, CAST(rank AS INTEGER) AS rank, rank <= greatest(1, k // 2) AS highly FROM k WHERE rank <= k
""")
def importance_top_third(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("model"), F.col("l_linenumber").alias("variable"), F.col("l_extendedprice").alias("importance"))
    return results.top_third(l)


@query("SELECT 'b1:' || l_returnflag AS segmented_regime_id, unnest(['l_quantity', 'l_linestatus']) AS column_name, unnest(['double', 'string']) AS dtype, CAST(unnest([count(DISTINCT l_quantity), count(DISTINCT l_linestatus)]) AS INTEGER) AS n_distinct, unnest([count(DISTINCT l_quantity) <= 1, count(DISTINCT l_linestatus) <= 1]) AS is_constant_in_regime FROM lineitem GROUP BY l_returnflag")
def segmentation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double"))
    return results.segmentation(l, "l_returnflag", "l_orderkey", ["l_quantity", "l_linestatus"], "b1")["experiment_regime_column_stats"]


@query("SELECT 'b1:' || o_orderstatus AS id, 'b1' AS batch_id, o_orderstatus AS regime_code, CAST(count(*) AS INTEGER) AS n_rows FROM orders GROUP BY o_orderstatus")
def segmentation_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.segmentation(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey", ["o_totalprice"], "b1")["experiment_segmented_regimes"]


# cleaning and numbering


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'No' ELSE o_orderstatus END AS answer FROM orders")
def no_capitalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "no").otherwise(F.col("o_orderstatus")).alias("answer"))
    return clean.capitalise_no(o, ["answer"])


@query("SELECT 0 AS step, 'read' AS name, count(*) AS n_rows, 3 AS n_columns FROM lineitem UNION ALL SELECT 1, 'outcome', count(*) FILTER (WHERE l_tax <> 0), 3 FROM lineitem UNION ALL SELECT 2, 'log', count(*) FILTER (WHERE l_tax <> 0), 4 FROM lineitem")
def transform_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("l_tax"))
    return clean.Steps(l).then("outcome", clean.drop_missing_outcome, "l_tax").then("log", lambda d: d.withColumn("log", F.ln("l_quantity"))).audit()


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders")
def global_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers over the whole table, by ranges of the order key."""
    return order.numbered(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "n").select("o_orderkey", "n")


@query("SELECT p_partkey, CAST(n AS DOUBLE) AS p_type_code FROM part JOIN (SELECT p_type, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS n FROM part GROUP BY 1) USING (p_type)")
def factorize_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.factorize(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", "p_partkey").select("p_partkey", "p_type_code")


@query("SELECT o_orderkey, round(ln(o_totalprice), 8) + 0.0 AS o_totalprice FROM orders")
def log_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = clean.transform_feature(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "log")
    return o.withColumn("o_totalprice", r6(F.col("o_totalprice"), 8))


# models and their diagnostics

_LINE = """
WITH o AS (SELECT o_orderkey AS k, CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM orders), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx FROM o),
e AS (SELECT k, x, y, y - a - b * x AS e, 1.0 / n + (x - mx) ** 2 / sxx AS h, n FROM o, f), v AS (SELECT sum(e * e) AS sse, sum(e * e) / (count(*) - 2) AS s2 FROM e)
"""


def _price_fit(spark: SparkSession, sf_dir: str):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    g = screening.gram(o, ["x", "y"])
    return o, g, screening.solve(g, "y", ("x",))


@query(
    _LINE
    + """SELECT count(*) FILTER (WHERE e * e / (2 * s2) * h / (1 - h) ** 2 > 4.0 / n) AS n_influential, count(*) FILTER (WHERE h > 2.0 / n) AS n_high_leverage,
round(max(abs(e) / sqrt((sse - e * e / (1 - h)) / (n - 3) * (1 - h))), 6) + 0.0 AS max_studentized FROM e, v"""
)
def influence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, _, fit = _price_fit(spark, sf_dir)
    d = screening.influence(o, fit)
    return spark.createDataFrame([(d["n_influential"], d["n_high_leverage"], round(d["max_studentized"], 6))], "n_influential long, n_high_leverage long, max_studentized double")


@query(_LINE + ", p AS (SELECT regr_r2(e * e, x) AS r1, corr(x, e * e) AS a, corr(x * x, e * e) AS b, corr(x, x * x) AS c, count(*) AS n FROM e) SELECT round((a * a + b * b - 2 * a * b * c) / (1 - c * c) * n, 4) + 0.0 AS white_lm FROM p")
def white_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White's statistic of a fit of one input."""
    o, _, fit = _price_fit(spark, sf_dir)
    return spark.createDataFrame([(round(screening.white(o, fit)[0], 4),)], "white_lm double")


@query()
def serial_and_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values of Breusch-Godfrey's and White's tests."""
    o, _, fit = _price_fit(spark, sf_dir)
    return spark.createDataFrame([(screening.serial_correlation(o, fit, "o_orderkey"), screening.heteroscedasticity(o, fit))], "breusch_godfrey_p double, white_p double")


@query(f"WITH e AS ({_JOINED}), c AS (SELECT corr(l_quantity, response) AS a, corr(p_retailprice, response) AS b, corr(l_quantity, p_retailprice) AS r FROM e) SELECT round((a - b * r) / (1 - r * r), 6) + 0.0 AS quantity, round((b - a * r) / (1 - r * r), 6) + 0.0 AS price FROM c")
def standardized_betas(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = screening.gram(experiment(spark, sf_dir), ["l_quantity", "p_retailprice", "response"])
    b = screening.standardized(g, screening.solve(g, "response", ("l_quantity", "p_retailprice")))
    return spark.createDataFrame([(round(b["l_quantity"], 6), round(b["p_retailprice"], 6))], "quantity double, price double")


@query("SELECT CAST(6 * 10 + 6 * 10 + 6 AS INTEGER) AS n_fits, CAST(7 * 10 + 7 * 10 + 7 AS INTEGER) AS n_fits_panel")
def fit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of a screening over five inputs that do not depend on each other: all subsets of two, three and five."""
    e = experiment(spark, sf_dir).withColumn("p_retailprice", F.pmod(F.xxhash64("p_retailprice"), F.lit(1000)).cast("double"))
    inputs = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]
    g = screening.gram(e, [*inputs, "response"])
    return spark.createDataFrame([(screening.fit_count(g, inputs, ["response"]), screening.fit_count(g, inputs, ["response"], panel=True))], "n_fits int, n_fits_panel int")


@query("""
WITH b AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, l_quantity, l_discount, l_returnflag, l_extendedprice AS y FROM lineitem), c AS (SELECT l_returnflag, row_number() OVER (ORDER BY min(row_id)) - 1 AS code FROM b GROUP BY 1)
SELECT row_id, CAST(l_quantity AS DOUBLE) AS l_quantity, l_discount, CAST(code AS DOUBLE) AS entity_code, y AS l_extendedprice FROM b JOIN c USING (l_returnflag)
""")
def panel_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumn("row_id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return screening.panel_design(l, ["l_quantity"], "l_extendedprice", "l_returnflag", "l_discount", "row_id")


@query(
    f"WITH e AS ({_JOINED}), c AS ("
    + " UNION ALL ".join(f"SELECT '{a},{b}' AS x, corr({a}, response) AS p, corr({b}, response) AS q, corr({a}, {b}) AS r FROM e" for i, a in enumerate(["l_quantity", "l_discount", "l_tax", "p_size"]) for b in ["l_quantity", "l_discount", "l_tax", "p_size"][i + 1 :])
    + "), f AS (SELECT x, (p * p + q * q - 2 * p * q * r) / (1 - r * r) AS r2 FROM c WHERE abs(r) < 0.95) SELECT x, round(r2, 5) + 0.0 AS r_squared FROM f WHERE r2 >= 0.06 ORDER BY r2 DESC, x LIMIT 3"
)
def candidates_by_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = ["l_quantity", "l_discount", "l_tax", "p_size"]
    g = screening.gram(experiment(spark, sf_dir), [*inputs, "response"])
    fits = [f for c in screening.candidates(inputs, ["response"], sizes=(2,)) if not screening.correlated(g, c.x) and (f := screening.solve(g, c.y, c.x)) and f.r_squared >= screening.MIN_R2]
    return spark.createDataFrame([(",".join(f.x), round(f.r_squared, 5)) for f in screening.best_by_r2(fits, 3)], "x string, r_squared double")


@query("""SELECT substring(sha256('run|' || p_type || '|' || replace(p_name, ' ', ',')), 1, 16) AS id, 'H' || (p_partkey + 1) AS hypothesis_id, round(p_retailprice / 7654, 4) + 0.0 AS r_squared, round(least(1, p_size / 40.0), 4) + 0.0 AS priority_score, p_retailprice / 7654 >= 0.06 AND p_size / 40.0 >= 0.3 AS validation_passed FROM part""")
def bundle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as ranked fits."""
    none = F.create_map().cast("map<string,double>")
    ranked = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("rank"), F.col("p_type").alias("y_col"), F.split("p_name", " ").alias("x_cols"), (F.col("p_retailprice") / 7654).alias("r_squared"), (F.col("p_size") / 40.0).alias("lit_score"), none.alias("coefficients"), none.alias("p_values"))
    out = screening.bundles(ranked, "run")
    return out.select("id", "hypothesis_id", r6(F.col("r_squared"), 4).alias("r_squared"), r6(F.col("priority_score"), 4).alias("priority_score"), "validation_passed")


_WITHIN = lambda by: f"SELECT sum(x * y) * sum(x * y) / (sum(x * x) * sum(y * y)) AS r2, count(*) AS n FROM (SELECT day - avg(day) OVER e AS x, total - avg(total) OVER e AS y FROM daily WINDOW e AS (PARTITION BY {by}))"


@query(
    DAILY
    + f""", a AS (SELECT c1, sum(a) AS auc, count(*) AS n FROM (SELECT c1, (day - lag(day) OVER w) * (total + lag(total) OVER w) / 2 AS a FROM daily WINDOW w AS (PARTITION BY c1 ORDER BY day, total)) GROUP BY 1)
SELECT 'o_global' AS id, 'ols' AS model_type, TRUE AS success, round(regr_r2(total, day), 6) + 0.0 AS r_squared, count(*) AS n FROM daily
UNION ALL SELECT 'o_even', 'ols', TRUE, round(regr_r2(total, day), 6) + 0.0, count(*) FROM daily WHERE user_id % 2 = 0 UNION ALL SELECT 'o_odd', 'ols', TRUE, round(regr_r2(total, day), 6) + 0.0, count(*) FROM daily WHERE user_id % 2 = 1
UNION ALL SELECT 'f_global', 'fixed_effects', TRUE, round(r2, 6) + 0.0, n FROM ({_WITHIN("user_id")})
UNION ALL SELECT 't_global_kinetics', 'two_stage_kinetics', TRUE, round(r2, 6) + 0.0, n FROM ({_WITHIN("c1")})
UNION ALL SELECT 't_global_treatment', 'two_stage_treatment', TRUE, round(regr_r2(auc, c1), 6) + 0.0, count(*) FROM a WHERE n >= 2
UNION ALL SELECT 'u_global', 'kernel', FALSE, 0.0, 0"""
)
def model_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round of families: least squares over all rows and by regime, effects, two stages, and one that is unknown."""
    d = daily(spark, sf_dir).withColumn("half", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")).withColumn("row_id", F.col("user_id") * 1_000_000 + F.col("day").cast("long"))
    h = model_rounds.Hypothesis
    linear, _, _ = model_rounds.fit_round(d, [h("o", "ols", "total", ("day",))], "row_id", regime="half")
    others, _, _ = model_rounds.fit_round(d, [h("f", "fixed_effects", "total", ("day",)), h("t", "two_stage", "total", ("c1", "day")), h("u", "kernel", "total", ("day",))], "row_id", entity="user_id", time="day")
    return spark.createDataFrame([(m.id, m.model_type, m.success, round(m.r_squared, 6) + 0.0, m.n) for m in linear + others], "id string, model_type string, success boolean, r_squared double, n long")


@query(_LINE + ", p AS (SELECT regr_r2(e * e, x) AS r1, corr(x, e * e) AS a, corr(x * x, e * e) AS b, corr(x, x * x) AS c, count(*) AS n FROM e) SELECT round(r1 * n, 4) + 0.0 AS breusch_pagan, round(a * a * n, 4) + 0.0 AS spread_lm FROM p")
def specification_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a fit's tests for spread, by inputs and by the fit."""
    o, g, fit = _price_fit(spark, sf_dir)
    a, r = screening.auxiliary_batch(o, [fit], g)[0], screening.residual_tests(o, [fit], "o_orderkey")[0]
    return spark.createDataFrame([(round(a["breusch_pagan"], 4), round(r["n"] * r["bp_lite_r2"], 4))], "breusch_pagan double, spread_lm double")


@query(
    DAILY
    + """, w AS (SELECT *, day - avg(day) OVER (PARTITION BY user_id) AS x, total - avg(total) OVER (PARTITION BY user_id) AS y FROM daily)
SELECT round(sum(x * y) / sum(x * x), 6) + 0.0 AS slope, round(sum(x * y) ** 2 / sum(x * x) / sum(y * y), 6) + 0.0 AS within_r2, count(*) AS n FROM w"""
)
def two_stage_kinetics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = models.two_stage_kinetics(daily(spark, sf_dir), "total", "user_id", "day")
    return spark.createDataFrame([(round(f.coefficients["day"], 6), round(f.within_r2, 6), f.n)], "slope double, within_r2 double, n long")


@query(
    DAILY
    + """, i AS (SELECT user_id, regr_intercept(total, day) AS a, arg_min(c1, day) AS x FROM daily GROUP BY 1 HAVING count(DISTINCT day) >= 2)
SELECT round(regr_slope(a, x), 3) + 0.0 AS slope, round(regr_r2(a, x), 6) + 0.0 AS r_squared, count(*) AS n FROM i"""
)
def two_stage_intercepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = models.two_stage_intercepts(daily(spark, sf_dir), "total", "user_id", "day", ["c1"], "day")
    return spark.createDataFrame([(round(f.coefficients["c1"], 3), round(f.r_squared, 6), f.n)], "slope double, r_squared double, n long")


# panels and search


@query("SELECT round(avg(x) * 100, 1) + 0.0 AS time_explains_pct, (SELECT string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) FROM (SELECT l_linenumber AS t FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, t LIMIT 5)) AS dominant_times FROM (SELECT unnest([0.125, 0.5]) AS x)")
def time_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    within = spark.createDataFrame([("a", 0.125), ("b", 0.5)], "output string, within_r2 double")
    out = panel.time_structure(within, table(spark, sf_dir, "lineitem").select(F.lit("a").alias("output"), F.col("l_linenumber").alias("time")))
    return out.select("time_explains_pct", F.array_join(F.col("dominant_times").cast("array<string>"), ",").alias("dominant_times"))


@query(
    DAILY
    + """, u AS (SELECT count(*) AS n, count(DISTINCT user_id) AS e, count(DISTINCT day) AS t FROM daily)
SELECT n AS n_rows, e AS n_entities, t AS n_timepoints, n > e AND t >= 2 AS is_panel, 'c1,c2,c3,c4,c5' AS composition, TRUE AS has_high, TRUE AS has_low FROM u"""
)
def dataset_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = panel.detect(daily(spark, sf_dir).withColumn("r", F.col("user_id") * 100_000 + F.col("day")), ["user_id"], ["c1", "total"], "day", "r")
    row = (d["n_rows"], d["n_entities"], d["n_timepoints"], d["is_panel"], ",".join(d["composition"]), d["has_high_index"], d["has_low_index"])
    return spark.createDataFrame([row], "n_rows long, n_entities long, n_timepoints long, is_panel boolean, composition string, has_high boolean, has_low boolean")


@query(_TOP + "SELECT query_id, 'corpus' AS source, 'title ' || doc_id AS title, round(s, 4) + 0.0 AS similarity_score, substring('text ' || doc_id, 1, 500) AS snippet FROM r WHERE rank = 1 AND round(s, 4) >= 0.18")
def corpus_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p: F.concat(F.lit(p), F.col("vec_id").cast("string"))
    chunks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), name("title ").alias("title"), name("file ").alias("source_file"), name("text ").alias("text"))
    out = retrieval.corpus_citations(_found(spark, sf_dir), chunks)
    return out.select("query_id", "source", "title", r6(F.col("similarity_score"), 4).alias("similarity_score"), "snippet")


@query(_TOP + ", f AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN doc_id % 10 END AS v FROM r WHERE rank <= 5), k AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY v DESC NULLS LAST, round(s, 4) DESC, doc_id) AS INTEGER) AS rank FROM f) SELECT * FROM k WHERE rank <= 3")
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir).where("rank <= 5")
    relevance = found.where("doc_id % 2 = 0").select("query_id", "doc_id", (F.col("doc_id") % 10).alias("relevance"))
    return retrieval.rerank(found, relevance, 3).select("query_id", "doc_id", "rank")


@query("SELECT vec_id AS chunk_id, 'new' AS embedding_model, round(CAST(CASE WHEN vec_id % 3 = 2 THEN embedding[1] ELSE embedding[2] END AS DOUBLE), 6) + 0.0 AS first FROM embeddings")
def embedding_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without a vector, or with another model's, get the new one; those of the model keep theirs."""
    k = F.col("vec_id") % 3
    e = table(spark, sf_dir, "embeddings")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.when(k != 0, F.col("embedding")).alias("embedding"), F.when(k == 1, "old").when(k == 2, "new").alias("embedding_model"))
    fresh = e.select(F.col("vec_id").alias("chunk_id"), F.slice("embedding", 2, 1).alias("embedding"))
    out = retrieval.backfill_embeddings(chunks, fresh, "new")
    return out.select("chunk_id", "embedding_model", r6(F.col("embedding")[0].cast("double")).alias("first"))


_BREAK = lambda b: f"CASE WHEN strpos(reverse(w), reverse({b})) > 0 THEN lower_ + length(w) - strpos(reverse(w), reverse({b})) + 1 END"  # noqa: E731  the place after the last one in w


@query(f"""
WITH RECURSIVE walk AS (
  SELECT doc_id, text, CAST(0 AS BIGINT) AS start, CAST(NULL AS BIGINT) AS stop FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, CASE WHEN stop IS NULL THEN start ELSE greatest(start + 1, stop - 256) END, CASE WHEN stop IS NULL THEN cut END
  FROM (SELECT *, CASE WHEN start + 2048 >= length(text) THEN length(text) ELSE coalesce({_BREAK("chr(10) || chr(10)")}, {_BREAK("'.' || chr(10)")}, {_BREAK("'. '")}, start + 2048) END AS cut
    FROM (SELECT *, start + 1433 AS lower_, substring(text, start + 1433 + 1, 2048 - 1433) AS w FROM walk)) WHERE stop IS NULL OR stop < length(text)),
cut AS (SELECT doc_id, start, trim(substring(text, start + 1, stop - start), E' \\t\\n\\r\\f' || chr(11)) AS chunk FROM walk WHERE stop IS NOT NULL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS chunk_index, CAST(start AS INTEGER) AS start, sha256(chunk) AS chunk FROM cut WHERE chunk <> ''""")
def chunk_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunker in SQL over whole texts."""
    retrieval.register_chunker(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("chunked_documents")
    return spark.sql("SELECT doc_id, c.chunk_index, c.start, sha2(c.chunk, 256) AS chunk FROM chunked_documents, LATERAL chunk_text(text, 512, 64) c")


@query("SELECT 'o_totalprice' AS outcome, count(o_totalprice) AS n, round(avg(o_totalprice), 4) + 0.0 AS mean FROM orders")
def outcome_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column that a loosely written outcome means, and what it holds."""
    o = table(spark, sf_dir, "orders")
    name = profile.resolve_outcome(o.columns, "O Total-Price")
    return o.agg(F.lit(name).alias("outcome"), F.count(name).alias("n"), r6(F.avg(name), 4).alias("mean"))
