"""Queries over what comes in (files, roles of columns, feeds) and over small rules, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.functions import text as tx
from assaygrid.operators import clean, models, panel, profile, results, retrieval, screening
from assaygrid.plans.registry import query, table
from assaygrid.plans.served import MODELS, store
from assaygrid.plans.tabular import _INPUTS, _JOINED, DAILY, daily, experiment, r6
from assaygrid.shared import fresh_path
from assaygrid.sources import feeds, tables


_NATIONS = "SELECT n_nationkey AS row_id, CAST(n_nationkey AS VARCHAR) AS n_nation_key, n_name AS name_and_more FROM nation"


def _delimited(spark: SparkSession, sf_dir: str, sep: str) -> str:
    path = fresh_path(spark, "intake")
    n = table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select(F.col("n_nationkey").alias("N Nation-Key"), F.concat(F.lit("  "), "n_name", F.lit(" ")).alias("Name (and, more)"), F.lit(None).cast("string").alias("Empty"))
    n.write.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query(_NATIONS)
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV with untidy names, padded cells and an empty column, in the order of its lines."""
    return tables.read_delimited(spark, _delimited(spark, sf_dir, ",")).withColumn("row_id", F.col("row_id").cast("long"))


@query(_NATIONS)
def tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_delimited(spark, _delimited(spark, sf_dir, "\t"), sep="\t", multi_line=False).withColumn("row_id", F.col("row_id").cast("long"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, 2 AS files FROM region")
def parquet_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's table from the cache: read twice, made once."""
    made = []

    def read(spark: SparkSession, path: str) -> DataFrame:
        made.append(path)
        return spark.read.parquet(path)

    cache = fresh_path(spark, "intake")
    path = f"{sf_dir}/region.parquet"
    first, second = (tables.cached(spark, path, cache, read) for _ in range(2))
    return first.agg(F.count("*").alias("n")).join(second.agg(F.lit(1 + len(made)).alias("files")))  # one row each


@query("SELECT CAST(o_orderkey % 3 AS VARCHAR) AS run_id, count(*) AS n FROM orders GROUP BY 1")
def run_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three runs persisted as partitions, one of them twice."""
    path = fresh_path(spark, "intake")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    for run in ("0", "1", "2", "1"):
        results.persist(o.where(F.col("o_orderkey") % 3 == int(run)), path, run)
    return spark.read.parquet(path).groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 1")
def empty_rows_and_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded strings are trimmed; rows and columns without a value go."""
    n = table(spark, sf_dir, "nation")
    keep = F.col("n_nationkey") % 2 == 1
    wide = n.select(F.when(keep, F.col("n_nationkey")).alias("n_nationkey"), F.when(keep, F.concat(F.lit(" "), "n_name", F.lit("  "))).alias("n_name"), F.lit(None).cast("string").alias("nothing"))
    return clean.trim_strings(clean.drop_empty(wide))


_CELL = "CASE p_partkey % 7 WHEN 0 THEN ' Meta ' || p_name WHEN 1 THEN 'Dependent  ' || p_name WHEN 2 THEN 'INDEPENDENT: ' || p_name WHEN 3 THEN 'response/' || p_brand WHEN 4 THEN p_name || ' covariate' WHEN 5 THEN p_name END"
_HAS = lambda words: " OR ".join(f"contains(x, '{w}')" for w in words)


@query(
    f"SELECT p_partkey, CASE WHEN {' OR '.join(f'starts_with(x, {chr(39)}{w}{chr(39)})' for w in tables.METADATA_WORDS)} THEN 'metadata' WHEN ({_HAS(tables.OUTPUT_WORDS)}) AND NOT contains(x, 'independent') THEN 'output' WHEN {_HAS(tables.INPUT_WORDS)} THEN 'input' ELSE 'unknown' END AS role "
    + f"FROM (SELECT p_partkey, trim(lower(coalesce({_CELL}, ''))) AS x FROM part)"
)
def role_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role cells made of part names, one by one."""
    k = F.col("p_partkey") % 7
    cell = F.when(k == 0, F.concat(F.lit(" Meta "), "p_name")).when(k == 1, F.concat(F.lit("Dependent  "), "p_name")).when(k == 2, F.concat(F.lit("INDEPENDENT: "), "p_name")).when(k == 3, F.concat(F.lit("response/"), "p_brand")).when(k == 4, F.concat("p_name", F.lit(" covariate"))).when(k == 5, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", tables.role_column(cell).alias("role"))


_POOL = ["l_quantity", "l_tax", "l_one", "l_rare"]
_POOLED = "(SELECT l_quantity, l_tax, 1.0 AS l_one, CASE WHEN l_orderkey % 5 = 0 THEN l_quantity END AS l_rare FROM lineitem)"


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) >= 8 AND count(DISTINCT {c}) >= 2 AS input, count({c}) >= 5 AND 2 * count({c}) >= count(*) AS output, count(DISTINCT {c}) > 1 AS varies FROM {_POOLED}" for c in _POOL))
def column_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", F.lit(1.0).alias("l_one"), F.when(F.col("l_orderkey") % 5 == 0, F.col("l_quantity")).alias("l_rare"))
    inputs, outputs, varies = profile.input_pool(l, _POOL), profile.output_pool(l, _POOL), profile.candidate_inputs(l, _POOL)[0]
    return spark.createDataFrame([(c, c in inputs, c in outputs, c in varies) for c in _POOL], "name string, input boolean, output boolean, varies boolean")


@query("SELECT 'event_id' AS entity, 'ts' AS time, 'event_type,value,props' AS features")
def detected_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", "props")
    p = [r.asDict() for r in profile.profile(e, 0).collect()]  # a row a column
    return spark.createDataFrame([(profile.detect_entity(p), profile.detect_time(p), ",".join(c for c in profile.infer_features(e.columns, "y") if c != "ts"))], "entity string, time string, features string")


_BY_PLACE = {"metadata": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "input": ["l_quantity", "l_extendedprice", "l_discount"], "output": ["l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]}


@query(" UNION ALL ".join(f"SELECT '{role}' AS role, '{c}' AS name, count(DISTINCT {c}) AS n_unique FROM lineitem" for role, cs in _BY_PLACE.items() for c in cs))
def column_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by role from their places, with what each holds."""
    l = table(spark, sf_dir, "lineitem")
    r = tables.legacy_layout(l.columns, (4, 7), 7)
    parts = [F.struct(F.lit(role).alias("role"), F.lit(c).alias("name"), F.count_distinct(F.col(c)).alias("n_unique")) for role, cs in (("metadata", r.metadata), ("input", r.inputs), ("output", r.outputs)) for c in cs]
    return l.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


# panels


@query(DAILY + " UNION ALL ".join(f"SELECT 'c{i}' AS \"column\", round(avg(CAST(c{i} > 0 AS INTEGER)), 6) + 0.0 AS positive, round(var_samp(c{i}), 4) + 0.0 AS variance FROM daily HAVING avg(CAST(c{i} > 0 AS INTEGER)) > 0.1 AND var_samp(c{i}) > 1e-6" for i in range(1, 6)))
def active_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    out = panel.active_outputs(d, panel.composition_columns(d.columns))
    return out.select("column", r6(F.col("positive")).alias("positive"), r6(F.col("variance"), 4).alias("variance"))


_SHARES = " + ".join(f"CASE WHEN c{i} > 0 THEN -c{i} / s * ln(c{i} / s) ELSE 0 END" for i in range(1, 6))


@query(DAILY + f"SELECT user_id, day, round({_SHARES}, 6) + 0.0 AS metric_entropy FROM (SELECT *, c1 + c2 + c3 + c4 + c5 AS s FROM daily)")
def augmented_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived metrics beside a panel's columns."""
    d = daily(spark, sf_dir)
    return panel.augment(d, panel.composition_columns(d.columns), "user_id", "day", "total").select("user_id", "day", r6(F.col("metric_entropy")).alias("metric_entropy"))


_TINY = "1e-12"
_P = lambda c, s: f"(({c} / {s} + {_TINY}) / (1 + 5 * {_TINY}))"
_KL = " + ".join(f"{_P(f'c{i}', 's')} * ln({_P(f'c{i}', 's')} / {_P(f'f{i}', 'fs')})" for i in range(1, 6))
_ENDS = lambda i, way: f"(SELECT avg(c{i}) FROM (SELECT c{i} FROM daily ORDER BY day {way}, total {way} LIMIT 3))"


@query(
    DAILY
    + ", falls AS ("
    + " UNION ALL ".join(f"SELECT 'c{i}' AS name, ({_ENDS(i, 'ASC')} - {_ENDS(i, 'DESC')}) / ({_ENDS(i, 'ASC')} + 1e-9) AS d FROM daily HAVING count(*) >= 4 AND max(c{i}) >= 0.01" for i in range(1, 6))
    + "), parent AS (SELECT name FROM falls ORDER BY d DESC, name LIMIT 1), "
    + "p AS (SELECT *, c1 + c2 + c3 + c4 + c5 AS s, CASE name WHEN 'c1' THEN c1 WHEN 'c2' THEN c2 WHEN 'c3' THEN c3 WHEN 'c4' THEN c4 ELSE c5 END AS c FROM daily, parent), "
    + "w AS (SELECT *, first(c) OVER u AS c0, " + ", ".join(f"first(c{i}) OVER u AS f{i}" for i in range(1, 6)) + ", first(s) OVER u AS fs FROM p WINDOW u AS (PARTITION BY user_id ORDER BY day)), "
    + "r AS (SELECT user_id, count(*) AS n, regr_slope(ln(greatest(c / c0, 1e-12)), day) AS b FROM w WHERE c0 >= 1e-12 GROUP BY 1) "
    + f"SELECT user_id, day, round({_SHARES}, 6) + 0.0 AS entropy, round(greatest(0, {_KL}), 6) + 0.0 AS divergence, coalesce(CASE WHEN n >= 3 AND b < 0 THEN round(-b, 6) END, 0.0) + 0.0 AS rate FROM w LEFT JOIN r USING (user_id)"
)
def panel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy, divergence from each user's first day and the rate of the component that falls most; users whose component does not decay have 0."""
    d = daily(spark, sf_dir)
    out = panel.augment(d, panel.composition_columns(d.columns), "user_id", "day", "total")
    return out.select("user_id", "day", r6(F.col("metric_entropy")).alias("entropy"), r6(F.col("metric_kl")).alias("divergence"), (F.coalesce("metric_rate", F.lit(0.0)) + 0.0).alias("rate"))


_SUM5 = "c1 + c2 + c3 + c4 + c5"


@query(
    DAILY
    + "SELECT 'total' AS name, 'direct' AS kind, 'panel_regression' AS approach, 'total' AS sources, count(*) FILTER (WHERE total > 0) AS n_nonzero, round(var_samp(total), 3) + 0.0 AS variance FROM daily HAVING avg(CAST(total > 0 AS INTEGER)) > 0.1 AND var_samp(total) > 1e-6 "
    + f"UNION ALL SELECT 'total_composition_concentration', 'derived_total', 'panel_regression', 'c1,c2,c3,c4,c5', count(*) FILTER (WHERE {_SUM5} > 0), round(var_samp({_SUM5}), 3) + 0.0 FROM daily HAVING avg(CAST({_SUM5} > 0 AS INTEGER)) > 0.1 AND var_samp({_SUM5}) > 1e-6 "
    + "UNION ALL SELECT 'shannon_entropy', 'derived_entropy', 'panel_regression', 'c1,c2,c3,c4,c5', count(*), 1.0 FROM daily "
    + "UNION ALL SELECT 'kl_divergence', 'derived_kl', 'panel_regression', 'c1,c2,c3,c4,c5', count(*), 1.0 FROM daily "
    + "UNION ALL SELECT 'degradation_rate_k', 'derived_rate', 'first_order_decay', 'c1,day', count(*), 1.0 FROM daily"
)
def modelable_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the users' days can be modelled: measured and derived outputs."""
    d = daily(spark, sf_dir)
    out = panel.modelable_outputs(d, "total", panel.composition_columns(d.columns), "c1", "day", True)
    return out.select("name", "kind", "approach", F.array_join("sources", ",").alias("sources"), "n_nonzero", r6(F.col("variance"), 3).alias("variance"))


# feeds


@query("SELECT 'europe_pmc' AS source, '10/' || p_partkey AS id, p_name AS title, '2019' AS year, 'https://doi.org/10/' || p_partkey AS url, 'A B,C' AS authors FROM part UNION ALL SELECT 'semantic_scholar', 's' || p_partkey, p_name, '2018', 'https://arxiv.org/abs/' || p_partkey, 'D' FROM part WHERE p_partkey % 2 = 0")
def more_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    item = F.struct(F.concat(F.lit("10/"), k).alias("doi"), F.col("p_name").alias("title"), F.lit("A B, C").alias("authorString"), F.lit("2019-02-01").alias("firstPublicationDate"))
    one = p.select(F.to_json(F.struct(F.struct(F.array(item).alias("result")).alias("resultList"))).alias("body"))
    work = F.struct(F.concat(F.lit("s"), k).alias("paperId"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 0, "text").otherwise("").alias("abstract"), F.lit(2018).alias("year"), F.array(F.struct(F.lit("D").alias("name"))).alias("authors"), F.struct(k.alias("ArXiv")).alias("externalIds"))
    two = p.select(F.to_json(F.struct(F.array(work).alias("data"))).alias("body"))
    both = feeds.europe_pmc(one).unionByName(feeds.semantic_scholar(two))
    return both.select("source", "id", "title", "year", "url", F.array_join("authors", ",").alias("authors"))


@query("SELECT 'arxiv' AS source, CAST(p_partkey AS VARCHAR) AS id, p_name AS title, 'one two' AS abstract, '2020' AS year, 'E' AS authors FROM part WHERE p_partkey % 3 <> 0")
def atom_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without an abstract go; white space is squeezed."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    entry = F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'>".replace("'", '"')), F.lit("<entry><id>http://arxiv.org/abs/"), k, F.lit("</id><title> "), "p_name", F.lit("\n</title><summary>"), F.when(F.col("p_partkey") % 3 != 0, "one\n  two").otherwise(""), F.lit("</summary><published>2020-01-02</published><author><name>E</name></author></entry></feed>"))
    return feeds.arxiv(p.select(entry.alias("body"))).select("source", "id", "title", "abstract", "year", F.array_join("authors", ",").alias("authors"))


@query("SELECT doc_id, coalesce(array_to_string(w, ' '), '') AS text FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each text back from their places."""
    d = table(spark, sf_dir, "documents")
    index = d.select("doc_id", feeds.to_inverted(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("m"))
    return index.select("doc_id", F.coalesce(feeds.from_inverted(F.col("m")), F.lit("")).alias("text"))


# rules


_P = "CAST(o_orderkey % 97 AS DOUBLE) / 1000"


@query(f"SELECT o_orderkey, CASE WHEN {_P} < 0.001 THEN '***' WHEN {_P} < 0.01 THEN '**' WHEN {_P} < 0.05 THEN '*' ELSE '' END AS stars FROM orders")
def significance_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.stars((F.col("o_orderkey") % 97).cast("double") / 1000).alias("stars"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN -1.0 ELSE o_totalprice END AS v FROM orders")
def safe_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, not-a-number and infinite values of a map give way to a fallback (0.5, or -1 here for nulls alone)."""
    k = F.col("o_orderkey") % 3
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.create_map(F.lit("v"), F.when(k == 0, F.lit(float("nan"))).when(k == 2, F.col("o_totalprice"))).alias("m"))
    safe = F.when(k == 1, results.json_safe(F.col("m"), -1.0)).otherwise(results.json_safe(F.col("m"), 0.5))
    return o.select("o_orderkey", safe["v"].alias("v"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS n_name FROM nation ORDER BY CAST(n_nationkey AS BIGINT) LIMIT 10")
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("n_name"))
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in results.preview(n, "n_nationkey", 10)], "n_nationkey string, n_name string")


@query("SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])), 6) + 0.0 AS cosine FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id + 1")
def neighbour_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    f = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(f, "vec_id").select("vec_id", r6(retrieval.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


@query(
    """WITH f AS (SELECT o_orderpriority AS name, regr_r2(o_totalprice, o_custkey) AS a, regr_r2(o_totalprice, o_orderkey) AS b, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT *, 1000 * a AS p, 1000 * b AS q FROM f)
SELECT name, CASE WHEN n % 3 = 0 THEN 'time_only' WHEN n % 3 = 1 THEN 'time_plus_parameter' ELSE 'parameter_only' END AS class, round(sqrt(least(1, p) * least(1, q)), 4) + 0.0 AS effective, round(1 - least(greatest((p - q - 0.05) / 0.25, 0), 1), 6) + 0.0 AS tree,
  round((0.5 * least(1, p / 0.6) + 0.5 * least(1, q / 0.6)) * CASE WHEN n % 20 < 10 THEN 0.8 ELSE 1 END, 6) + 0.0 AS two_stage, round(0.6 * least(greatest(p, 0), 1) + 0.4 * least(1, q), 6) + 0.0 AS lasso, CAST(0.4 AS DOUBLE) AS ridge FROM s"""
)
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of models from what fits of orders say, by priority."""
    o = table(spark, sf_dir, "orders")
    rows = []
    for r in o.groupBy("o_orderpriority").agg(F.regr_r2("o_totalprice", "o_custkey").alias("a"), F.regr_r2("o_totalprice", "o_orderkey").alias("b"), F.count("*").alias("n")).collect():  # a row a priority
        p, q, n = 1000 * r["a"], 1000 * r["b"], r["n"]
        x = (["t"], ["t", "x"], ["x"])[n % 3]
        rows.append((r["o_orderpriority"], screening.model_class(x, "t"), screening.effective(min(1.0, p), min(1.0, q)), round(models.tree_score(p - q, q), 6), round(models.two_stage_score(p, q, n % 20), 6), round(models.lasso_score(p, min(1.0, q)), 6), screening.RIDGE_SCORE))
    return spark.createDataFrame(rows, "name string, class string, effective double, tree double, two_stage double, lasso double, ridge double")


@query(f"WITH e AS ({_JOINED}), r AS (SELECT regr_r2(response, l_quantity) AS r2, count(*) AS n, regr_syy(response, l_quantity) AS syy FROM e) SELECT n, round(r2 * (n - 2) / (1 - r2), 2) + 0.0 AS f, round(n * ln((1 - r2) * syy / n), 2) + 0.0 AS shape FROM r")
def overall_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit's F, and the part of AIC and BIC that depends on data."""
    fit = screening.solve(screening.gram(experiment(spark, sf_dir), ["l_quantity", "response"]), "response", ("l_quantity",))
    import math

    return spark.createDataFrame([(fit.n, round(fit.f, 2), round(fit.n * math.log(fit.sse / fit.n), 2))], "n long, f double, shape double")


@query(
    f"WITH e AS ({_JOINED}), f AS (SELECT regr_slope(response, l_quantity) AS b, regr_intercept(response, l_quantity) AS a FROM e), u AS (SELECT l_quantity AS x, (response - a - b * l_quantity) ** 2 AS e2 FROM e, f) SELECT round(regr_r2(e2, x) * count(*), 4) + 0.0 AS koenker FROM u"
)
def koenker_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breusch and Pagan's statistic in Koenker's form, of one input, as the tests of many fits give it."""
    e = experiment(spark, sf_dir)
    g = screening.gram(e, ["l_quantity", "response"])
    fit = screening.solve(g, "response", ("l_quantity",))
    return spark.createDataFrame([(round(screening.auxiliary_batch(e, [fit], g)[0]["breusch_pagan"], 4),)], "koenker double")


@query(f"WITH e AS ({_JOINED}) SELECT l_quantity > 25 AS heavy, round(regr_r2(response, p_size), 5) + 0.0 AS r_squared, count(*) AS n FROM e GROUP BY 1")
def regime_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit for each regime, from one Gram pass over all."""
    e = experiment(spark, sf_dir).withColumn("heavy", (F.col("l_quantity") > 25).cast("string"))
    g = screening.gram(e, [*_INPUTS, "response"], ["heavy"])
    fits = [(k, screening.solve(g, "response", ("p_size",), k)) for k in g.sums]
    return spark.createDataFrame([(k[0] == "true", round(f.r_squared, 5), f.n) for k, f in fits], "heavy boolean, r_squared double, n long")


@query(MODELS + "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS run_name FROM nation WHERE n_nationkey = 8 AND n_regionkey % 2 = 1")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.summary(store(spark, sf_dir)["runs"], "user_1", "8").select("id", "run_name")


# text

_W = "list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
_CORE = "regexp_replace(x, '^[.,!?;:()\\[\\]\"'']+|[.,!?;:()\\[\\]\"'']+$', '', 'g')"
_QUOTED = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@query(
    f"""
WITH t AS (SELECT conv_id, turn, text, length(text) AS n, {_W} AS w FROM conversations),
s AS (SELECT *, list_filter(list_transform(w, lambda x: lower({_CORE})), lambda x: length(x) >= 4 AND NOT list_contains([{_QUOTED(tx.PROSE_STOPWORDS)}], x)) AS sig FROM t),
g AS (SELECT *, n >= 15 AND length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / n <= 0.015 AND NOT list_bool_or(list_transform([{_QUOTED(tx.BAD_STARTS)}], lambda b: starts_with(lower(text), b)))
AND NOT list_bool_or(list_transform([{_QUOTED(tx.GARBAGE)}], lambda b: contains(text, b))) AND NOT regexp_matches(text, '[^\\pL\\pM\\pN\\p{{Pc}}\\s]{{3,}}') AND len(w) >= 6
AND len(list_filter(w, lambda x: regexp_matches({_CORE}, '[*|\\\\@#{{}}_%]'))) / len(w) <= 0.15
AND coalesce(list_max(list_transform(list_distinct(sig), lambda v: len(list_filter(sig, lambda y: y = v)))), 0) / len(w) <= 0.20 AS good, length(regexp_replace(text, '[^\\pL ]', '', 'g')) / n AS alpha FROM s)
SELECT conv_id, turn, coalesce(good AND alpha >= 0.65, FALSE) AS sentence, coalesce(good AND alpha >= 0.60, FALSE) AS browser FROM g"""
)
def clean_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("marks", tx.sentence_marks(F.col("text")))
    return c.select("conv_id", "turn", tx.is_clean_sentence(F.col("text"), marks=F.col("marks")).alias("sentence"), tx.is_clean_sentence(F.col("text"), 0.60, F.col("marks")).alias("browser"))


@query("WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Output: ' || p_name WHEN 1 THEN ':: ' || p_name ELSE p_name END AS x FROM part) SELECT p_partkey, trim(p.p_name) AS label_free FROM t JOIN part p USING (p_partkey)")
def label_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    x = F.when(k == 0, F.concat(F.lit("Output: "), "p_name")).when(k == 1, F.concat(F.lit(":: "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.strip_label(x).alias("label_free"))


@query("SELECT p_partkey, 'It was seen that the yield of ' || p_brand || ' is higher at every dose that was tried. Each of the other parts that were tried in water did no better than this.' AS answer FROM part")
def thinking_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thinking blocks, labels and repeated sentences go; the last two long sentences stay."""
    good = F.concat(F.lit("It was seen that the yield of "), "p_brand", F.lit(" is higher at every dose that was tried"))
    other = F.lit("Each of the other parts that were tried in water did no better than this")
    text = F.concat(F.lit("<think>we need a sentence. OK: go</think> Short one. "), good, F.lit(". "), good, F.lit(". "), other, F.lit("."))
    return table(spark, sf_dir, "part").select("p_partkey", tx.strip_thinking(text).alias("answer"))
