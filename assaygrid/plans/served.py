"""Queries over the results store (customers, orders and lines stand in for hypotheses, models and citations), the corpus and its text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaygrid.functions import text as tx
from assaygrid.operators import results, retrieval
from assaygrid.plans.registry import query, table
from assaygrid.plans.tabular import r6
from assaygrid.sources import feeds
from assaygrid.streaming import activity


def store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Runs are nations, hypotheses customers, models orders, validations finished orders, citations lines."""
    nation, customer, orders, line = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders", "lineitem"))
    return {
        "runs": nation.select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("user_"), (F.col("n_regionkey") % 2).cast("string")).alias("user_sub"), F.col("n_name").alias("run_name"), F.timestamp_seconds(F.col("n_nationkey") * 3600).alias("created_at")),
        "hypotheses": customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("run_id"), (F.col("c_custkey") % 3).cast("int").alias("round"), F.col("c_mktsegment").alias("model_family"), F.col("c_acctbal").alias("priority_score")),
        "model_results": orders.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("hypothesis_id"),
            (F.col("o_totalprice") / 1e6).alias("r_squared"),
            (F.col("o_totalprice") / 1.1e6).alias("adj_r_squared"),
            ((F.col("o_orderkey") % 100) / 100.0).alias("match_score"),
            F.array(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("significant_variables"),
            F.create_map(F.lit("const"), F.lit(1.0), F.lit("price"), F.col("o_totalprice"), F.lit("key"), -(F.col("o_orderkey") % 1000).cast("double"), F.col("o_orderpriority"), F.lit(0.5)).alias("coefficients"),
        ),
        "validation_results": orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("model_result_id"), (F.col("o_orderstatus") == "F").alias("overall_passed")),
        "citations": line.select(F.col("l_orderkey").alias("model_result_id"), F.col("l_returnflag").alias("source"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("title"), (F.col("l_partkey") % 7).cast("string").alias("url"), F.year("l_shipdate").cast("string").alias("year"), F.col("l_discount").alias("similarity_score"), F.xxhash64(*line.columns).alias("id")),
    }


MODELS = """
WITH h AS (SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS run_id, CAST(c_custkey % 3 AS INTEGER) AS round, c_acctbal AS priority_score FROM customer),
m AS (SELECT o_orderkey AS id, o_custkey AS hypothesis_id, o_totalprice / 1e6 AS r_squared, o_totalprice / 1.1e6 AS adj_r_squared, (o_orderkey % 100) / 100.0 AS match_score, o_orderpriority AS p, o_orderstatus AS s FROM orders),
v AS (SELECT o_orderkey AS model_result_id, o_orderstatus = 'F' AS overall_passed FROM orders WHERE o_orderkey % 3 <> 0)
"""


@query(MODELS + "SELECT m.id, round(r_squared, 6) + 0.0 AS r_squared, overall_passed AS validation_passed FROM m JOIN h ON h.id = hypothesis_id LEFT JOIN v ON model_result_id = m.id WHERE run_id = '7'")
def model_left_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return results.models_of(s["hypotheses"], s["model_results"], s["validation_results"], "7").select("id", r6(F.col("r_squared")).alias("r_squared"), "validation_passed")


@query(MODELS + "SELECT run_id, round, round(avg(match_score), 6) + 0.0 AS avg_match, round(max(r_squared), 6) + 0.0 AS max_r2, count(*) AS n_models, count(*) FILTER (WHERE overall_passed) AS n_passed FROM h JOIN m ON h.id = hypothesis_id LEFT JOIN v ON model_result_id = m.id GROUP BY 1, 2")
def convergence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    c = results.convergence(s["hypotheses"], s["model_results"], s["validation_results"])
    return c.withColumns({"avg_match": r6(F.col("avg_match")), "max_r2": r6(F.col("max_r2"))})


@query(MODELS + ", c AS (SELECT run_id, round, avg(match_score) AS a FROM h JOIN m ON h.id = hypothesis_id GROUP BY 1, 2) SELECT run_id, round, round(a - lag(a) OVER (PARTITION BY run_id ORDER BY round), 6) + 0.0 AS improvement FROM c")
def round_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    c = results.improvement(results.convergence(s["hypotheses"], s["model_results"], s["validation_results"]))
    return c.select("run_id", "round", r6(F.col("improvement")).alias("improvement"))


@query(MODELS + "SELECT variable, count(*) AS n, round(avg(match_score), 6) + 0.0 AS avg_match, round(avg(r_squared), 6) + 0.0 AS avg_r2 FROM (SELECT unnest([p, s]) AS variable, match_score, r_squared FROM m) GROUP BY 1")
def top_variables_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = results.top_variables(store(spark, sf_dir)["model_results"])
    return t.withColumns({"avg_match": r6(F.col("avg_match")), "avg_r2": r6(F.col("avg_r2"))})


@query("SELECT 'part ' || l_partkey AS title, CAST(l_partkey % 7 AS VARCHAR) AS url, l_returnflag AS source, CAST(year(l_shipdate) AS VARCHAR) AS year, count(*) AS n, round(avg(l_discount), 6) + 0.0 AS avg_similarity FROM lineitem GROUP BY 1, 2, 3, 4")
def top_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.top_citations(store(spark, sf_dir)["citations"]).withColumn("avg_similarity", r6(F.col("avg_similarity")))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS run_name, count(c_custkey) AS n_hypotheses FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey % 2 = 1 GROUP BY 1, 2, n_nationkey ORDER BY n_nationkey DESC LIMIT 50")
def runs_latest50(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return results.runs_latest(s["runs"], s["hypotheses"], "user_1").select("id", "run_name", "n_hypotheses")


@query(MODELS + "SELECT id, round, round(priority_score, 2) + 0.0 AS priority_score FROM h WHERE run_id = '3' AND round = 1")
def hypotheses_by_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.hypotheses_of(store(spark, sf_dir)["hypotheses"], "3", 1).select("id", "round", r6(F.col("priority_score"), 2).alias("priority_score"))


@query(MODELS + "SELECT count(*) AS n, round(sum(s), 6) + 0.0 AS total FROM (SELECT l_discount AS s FROM lineitem JOIN m ON m.id = l_orderkey JOIN h ON h.id = hypothesis_id WHERE run_id = '5' ORDER BY s DESC LIMIT 100)")
def citations_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    top = results.citations_of(s["hypotheses"], s["model_results"], s["citations"], "5")
    return top.agg(F.count("*").alias("n"), r6(F.sum("similarity_score")).alias("total"))


@query(
    MODELS
    + """, c AS (SELECT id, unnest(['price', 'key', p]) AS variable, unnest([r_squared * 1e6, -CAST(id % 1000 AS DOUBLE), 0.5]) AS coefficient FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(coefficient) DESC, variable) AS rank, max(abs(coefficient)) OVER (PARTITION BY id) AS top FROM c)
SELECT id, variable, round(coefficient, 2) + 0.0 AS coefficient, CAST(rank AS INTEGER) AS rank, CAST(greatest(10, round(abs(coefficient) / top * 48)) AS INTEGER) AS width FROM r WHERE rank <= 2"""
)
def effects_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = results.effects_top(store(spark, sf_dir)["model_results"], n=2)
    return e.withColumn("coefficient", r6(F.col("coefficient"), 2))


@query(MODELS + "SELECT id, round(adj_r_squared * (0.5 + match_score), 6) + 0.0 AS dashboard_score FROM m ORDER BY adj_r_squared * (0.5 + match_score) DESC, id LIMIT 3")
def dashboard_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.dashboard_top(store(spark, sf_dir)["model_results"]).select("id", r6(F.col("dashboard_score")).alias("dashboard_score"))


@query("SELECT l_returnflag AS source, max(l_discount) AS similarity_score FROM lineitem GROUP BY 1")
def best_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.best_per_source(store(spark, sf_dir)["citations"]).select("source", "similarity_score")


@query("SELECT count(*) AS n_papers, CAST(sum(ceil(greatest(length(text), 1) / 2048.0)) AS BIGINT) AS n_chunks, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS n_tokens FROM documents WHERE source = 'src1'")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    papers = d.select(F.col("source").alias("user_sub"), F.ceil(F.greatest(F.length("text"), F.lit(1)) / 2048).alias("n_chunks"), tx.token_estimate(F.col("text")).alias("n_tokens"))
    return results.corpus_stats(papers, "src1")


@query("""
WITH r AS (SELECT l_returnflag AS variable, l_linestatus || l_linenumber AS output, corr(l_quantity, l_tax) AS c FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, abs(c) > 0.005 AS sig FROM r)
SELECT variable, count(*) AS tested, round(count(*) FILTER (WHERE sig) / count(*), 2) + 0.0 AS consistency,
CASE WHEN count(*) FILTER (WHERE sig AND c > 0) > count(*) FILTER (WHERE sig AND c < 0) THEN 'positive' WHEN count(*) FILTER (WHERE sig AND c < 0) > count(*) FILTER (WHERE sig AND c > 0) THEN 'negative' ELSE 'mixed' END AS direction,
coalesce(string_agg(output, ',' ORDER BY output) FILTER (WHERE sig), '') AS outputs FROM s GROUP BY 1
""")
def consistency_by_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumn("output", F.concat("l_linestatus", F.col("l_linenumber").cast("string")))
    rows = l.groupBy(F.col("l_returnflag").alias("variable"), "output").agg(F.corr("l_quantity", "l_tax").alias("coefficient")).withColumn("significant", F.abs("coefficient") > 0.005)
    return results.consistency(rows)


@query(MODELS + ", u AS (SELECT hypothesis_id AS \"group\", unnest([p, s]) AS v FROM m) SELECT \"group\", array_to_string(list_sort(list(DISTINCT v)), ',') AS significant, 'const,key,price' AS not_significant FROM u GROUP BY 1")
def significant_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = results.significant_union(store(spark, sf_dir)["model_results"], "hypothesis_id")
    return u.select("group", F.array_join("significant", ",").alias("significant"), F.array_join("not_significant", ",").alias("not_significant"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE run = '4') AS of_run FROM (SELECT o_orderkey, CAST(c_nationkey AS VARCHAR) AS run FROM orders JOIN customer ON c_custkey = o_custkey) WHERE run <> '4'")
def delete_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = results.delete_run(store(spark, sf_dir), "4")
    left = rest["model_results"].join(rest["hypotheses"].select(F.col("id").alias("hypothesis_id"), "run_id"), "hypothesis_id", "left")
    return left.agg(F.count("*").alias("n"), F.count_if(F.col("run_id") == "4").alias("of_run"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return results.upsert(old, old.where("c_custkey % 2 = 0").withColumn("segment", F.lit("new")), ["c_custkey"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_new_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.new_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS hash FROM documents GROUP BY text")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return retrieval.keep_first(d, ["hash"], ["doc_id"])


_NORM = "trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[^\\p{L}\\p{N}\\p{M}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""
WITH e AS (SELECT p_partkey AS id, {_NORM} AS norm_title, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS prio FROM part)
SELECT norm_title, arg_min(CAST(id AS VARCHAR), prio::VARCHAR || CAST(id AS VARCHAR)) AS id, string_agg(DISTINCT CASE WHEN prio = 0 THEN 'arxiv' ELSE 's2' END, ',' ORDER BY CASE WHEN prio = 0 THEN 'arxiv' ELSE 's2' END) AS sources FROM e WHERE norm_title <> '' GROUP BY 1
""")
def cross_source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return retrieval.merge_sources([("arxiv", p.where("id % 2 = 0")), ("s2", p.where("id % 2 = 1"))]).select("norm_title", "id", "sources")


@query("SELECT min(page_id) AS id, lower(url) AS url FROM pages WHERE url <> '' GROUP BY 2")
def citation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cited twice, once in capitals, by their whole addresses."""
    c = table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("id"), F.lit("").alias("title")).where("url <> ''")
    again = c.select(F.upper("url").alias("url"), (F.col("id") + 1_000_000_000).alias("id"), "title")
    return retrieval.dedupe_citations(c.unionByName(again), ["id"]).select("id", F.lower("url").alias("url"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.drop_reference_chunks(retrieval.chunk(table(spark, sf_dir, "documents")))


@query(r"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'see doi:1 and DOI:2 or https://doi.org/3 ' || text WHEN doc_id % 7 = 0 THEN text || ' [1] [2] [3] [4] [5]' ELSE text END AS x FROM documents),
c AS (SELECT *, list_filter(string_split_regex(x, '\r\n|[\n\r]'), lambda l: trim(l) <> '') AS lines, len(regexp_extract_all(x, '(?i)\bet\s+al\.')) AS et, len(regexp_extract_all(x, '(?i)(?:doi:|https?://doi\.org/)')) AS doi,
len(regexp_extract_all(x, '\([A-Z][a-z]+(?:\s+et\s+al\.)?,\s*\d{4}\)')) AS ay, list_transform(regexp_extract_all(x, '\[(\d+)\]', 1), lambda v: TRY_CAST(v AS BIGINT)) AS nums FROM t)
SELECT doc_id, coalesce(len(lines) > 0 AND (et > 6 OR doi >= 3 OR (len(nums) >= 5 AND len(list_filter(range(1, len(nums)), lambda i: nums[i + 1] - nums[i] <> 1)) = 0)
OR (len(list_filter(lines, lambda l: length(trim(l)) < 80)) / len(lines) > 0.6 AND (et > 3 OR ay > 3 OR doi > 1))), FALSE) AS listed FROM c
""")
def ref_chunk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("see doi:1 and DOI:2 or https://doi.org/3 "), "text")).when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" [1] [2] [3] [4] [5]"))).otherwise(F.col("text"))
    return d.select("doc_id", tx.is_reference_chunk(text).alias("listed"))


@query(r"""
WITH t AS (SELECT doc_id, text || chr(10) || CASE WHEN doc_id % 4 = 0 THEN 'REFERENCES ' || chr(10) || '[1] a' ELSE 'tail' END AS x FROM documents)
SELECT doc_id, length(string_split_regex(x, '(?i)\n(?:References|Bibliography|Works\s+Cited)\s*\n')[1]) AS n FROM t
""")
def truncate_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.lit("\n"), F.when(F.col("doc_id") % 4 == 0, "REFERENCES \n[1] a").otherwise("tail"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(tx.truncate_references(text)).cast("long").alias("n"))


@query("""
WITH l AS (SELECT doc_id, list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1, 5) AS lines FROM documents),
b AS (SELECT doc_id, lines, list_max(list_transform(lines, lambda x: length(x))) AS m FROM l)
SELECT doc_id, CASE WHEN m > 10 THEN substring(list_filter(lines, lambda x: length(x) = m)[1], 1, 200) ELSE 'doc ' || doc_id END AS title FROM b
""")
def title_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.pick_title(F.col("text"), F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).alias("title"))


@query("SELECT lang, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS n_tokens, CAST(max(greatest(1, length(text) // 4)) AS BIGINT) AS longest FROM documents GROUP BY 1")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tx.token_estimate(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(n).alias("n_tokens"), F.max(n).alias("longest"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS text FROM pages")
def tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("text"))


_STOP = ", ".join(f"'{w}'" for w in tx.SEARCH_STOPWORDS)


@query(f"""
WITH t AS (SELECT doc_id, regexp_extract_all(replace(lower(text), '_', ' '), '[a-z][a-z0-9]{{2,}}') AS w FROM documents),
u AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t), f AS (SELECT doc_id, w[i] AS x, min(i) AS i FROM u WHERE w[i] NOT IN ({_STOP}) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
SELECT d.doc_id, coalesce(string_agg(x, ' ' ORDER BY n), '') AS terms FROM documents d LEFT JOIN (SELECT * FROM k WHERE n <= 10) k USING (doc_id) GROUP BY 1
""")
def keyword_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.keyword_terms(F.col("text")), " ").alias("terms"))


@query(
    "SELECT p_partkey, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {' OR '.join(f'contains(x, {chr(39)}{n}{chr(39)})' for n in needles)} THEN '{term}' END" for needles, term in tx.PROCESS_RULES)
    + "], lambda v: v IS NOT NULL), ',') AS terms FROM (SELECT p_partkey, lower(p_name || ' ' || p_type || CASE WHEN p_partkey % 3 = 0 THEN ' UV lamp' ELSE ' carbon' END) AS x FROM part)"
)
def process_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    text = F.concat_ws(" ", "p_name", "p_type", F.when(F.col("p_partkey") % 3 == 0, "UV lamp").otherwise("carbon"))
    return p.select("p_partkey", F.array_join(tx.process_terms(text), ",").alias("terms"))


@query(
    f"""
WITH t AS (SELECT p_partkey, lower(p_name || ' ' || p_type || ' removal water') AS x FROM part), w AS (SELECT *, regexp_extract_all(replace(x, '_', ' '), '[a-z][a-z0-9]{{2,}}') AS a FROM t),
k AS (SELECT *, list_slice(list_filter(list_filter(a, lambda v, i: list_position(a, v) = i), lambda v: v NOT IN ({_STOP})), 1, 10) AS terms, list_filter(["""
    + ", ".join(f"CASE WHEN {' OR '.join(f'contains(x, {chr(39)}{n}{chr(39)})' for n in needles)} THEN '{term}' END" for needles, term in tx.PROCESS_RULES)
    + """], lambda v: v IS NOT NULL) AS process FROM w), q AS (SELECT p_partkey, list_concat(list_concat(terms, process), ['degradation', 'water treatment']) AS all_terms FROM k)
SELECT p_partkey, array_to_string(list_filter(all_terms, lambda v, i: list_position(all_terms, v) = i), ' ') AS query FROM q"""
)
def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.search_query(F.concat_ws(" ", "p_name", "p_type", F.lit("removal water"))).alias("query"))


_COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[]))"
_TOP = f"WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {_COS} AS s FROM embeddings q JOIN embeddings d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM s) "


def _found(spark: SparkSession, sf_dir: str, k: int = 9, **how: int) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings")
    found = retrieval.top_k(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e, k, doc_id="vec_id", **how).where("query_id <> doc_id")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


@query(_TOP + "SELECT query_id, doc_id, round(s, 4) + 0.0 AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50 against all rows, neither side through the driver."""
    return _found(spark, sf_dir, small=0).where("rank <= 5").select("query_id", "doc_id", r6(F.col("similarity"), 4).alias("similarity"), "rank")


@query(_TOP + ", f AS (SELECT doc_id, arg_min(s, query_id) AS s FROM (SELECT * FROM r WHERE rank <= 8) GROUP BY 1) SELECT doc_id, round(s, 4) + 0.0 AS similarity FROM f ORDER BY round(s, 4) DESC, doc_id LIMIT 10")
def multi_query_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.multi_query(_found(spark, sf_dir).where("rank <= 8"), 10).select("doc_id", r6(F.col("similarity"), 4).alias("similarity"))


@query(_TOP + "SELECT query_id, coalesce(max(s) FILTER (WHERE s >= 0.18), 0.0) + 0.0 AS lit_score FROM (SELECT query_id, round(s, 4) AS s FROM r WHERE rank <= 8) GROUP BY 1")
def lit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.literature_score(_found(spark, sf_dir).where("rank <= 8"))


@query("""
WITH x AS (SELECT doc_id, quality, toxic, (doc_id % 11) / 10.0 AS rag, 1 - (doc_id % 7) / 6.0 AS papers FROM labels)
SELECT doc_id, round(least(1, greatest(0, 0.5 * rag + 0.3 * papers + 0.2 * quality)), 4) + 0.0 AS match_score FROM x
""")
def grounding_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "labels").select("doc_id", "quality", ((F.col("doc_id") % 11) / 10.0).alias("rag"), (1 - (F.col("doc_id") % 7) / 6.0).alias("papers"))
    return retrieval.grounding_score(x, "rag", "papers", "quality").select("doc_id", r6(F.col("match_score"), 4).alias("match_score"))


@query(
    MODELS
    + """, g AS (SELECT id, r_squared, match_score AS lit_score, 0.5 + (id % 2) / 2.0 AS diagnostic_score FROM m), s AS (SELECT count(*) AS n FROM g WHERE lit_score >= 0.3)
SELECT id, round(lit_score * r_squared * diagnostic_score, 6) + 0.0 AS key FROM g, s WHERE n < 2 OR lit_score >= 0.3 ORDER BY lit_score * r_squared * diagnostic_score DESC, lit_score DESC, r_squared DESC, id LIMIT 6"""
)
def grounded_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = store(spark, sf_dir)["model_results"].withColumnRenamed("match_score", "lit_score").withColumn("diagnostic_score", 0.5 + (F.col("id") % 2) / 2.0)
    return retrieval.rank_grounded(m).select("id", r6(F.col("key")).alias("key"))


@query("""
WITH p AS (SELECT l_orderkey AS candidate, CASE l_linenumber % 3 WHEN 0 THEN 'crossref' WHEN 1 THEN 'openalex' ELSE 'arxiv' END AS provider, l_partkey AS paper, round(0.4 + l_discount, 2) AS s FROM lineitem),
b AS (SELECT candidate, provider, max(s) AS s, CASE provider WHEN 'openalex' THEN 1 WHEN 'crossref' THEN 3 ELSE 5 END AS o FROM p WHERE s >= 0.45 GROUP BY 1, 2)
SELECT candidate, provider, s AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY o) AS k FROM b) WHERE k <= 2
""")
def provider_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber") % 3
    papers = l.select(F.col("l_orderkey").alias("candidate"), F.when(n == 0, "crossref").when(n == 1, "openalex").otherwise("arxiv").alias("provider"), F.col("l_partkey").alias("paper"), F.round(0.4 + F.col("l_discount"), 2).alias("similarity"))
    return retrieval.best_external(papers).select("candidate", "provider", "similarity")


@query()
def clean_sentence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("marks", tx.sentence_marks(F.col("text")))
    t, m = F.col("text"), F.col("marks")
    return c.select("conv_id", "turn", tx.is_clean_sentence(t, marks=m).alias("sentence"), tx.is_clean_sentence(t, 0.60, m).alias("browser"), tx.is_clean_paragraph(t, m).alias("paragraph"), tx.strip_label(t).alias("label_free"), tx.strip_thinking(t).alias("answer"))


@query("""
WITH t AS (SELECT p_partkey, 'Part ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' drives the yield of water' ELSE ' among other things' END AS x FROM part), w AS (SELECT *, string_split_regex(trim(x), '\\s+') AS w FROM t),
g AS (SELECT *, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: lower(w[i]) || ' ' || lower(w[i + 1]) || ' ' || lower(w[i + 2])) ELSE [] END AS tri FROM w)
SELECT p_partkey, len(w) BETWEEN 5 AND 12 AND NOT contains(x, '?') AND NOT contains(rtrim(x, '.'), '.') AND len(tri) = len(list_distinct(tri)) AND p_partkey % 2 = 0 AS good FROM g
""")
def clean_title_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    title = F.concat(F.lit("Part "), "p_name", F.when(F.col("p_partkey") % 2 == 0, " drives the yield of water").otherwise(" among other things"))
    return p.select("p_partkey", tx.is_clean_title(title).alias("good"))


@query("SELECT p_partkey, len(string_split(p_type, ' ')) BETWEEN 2 AND 15 AS good, p_type AS label FROM part")
def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.is_clean_domain(F.concat(F.lit("Domain: "), "p_type")).alias("good"), tx.humanize(F.col("p_type")).alias("label"))


@query("""
WITH s AS (SELECT conv_id AS query_id, turn AS rank, '[Source: ' || substring(role, 1, 80) || ' | File: f | Similarity: 0.50]' || chr(10) || text AS section FROM conversations),
r AS (SELECT *, sum(length(section)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM s)
SELECT query_id, string_agg(section, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_chunks FROM r WHERE used <= 4000 GROUP BY 1
""")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return retrieval.pack_context(c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text", F.col("role").alias("title"), F.lit("f").alias("source_file"), F.lit(0.5).alias("similarity")))


@query("SELECT doc_id, substring(md5(source || '_' || doc_id), 1, 12) AS short_id, sha256(doc_id || ':0:' || text) AS chunk_hash, 'user_' || substring(sha256(source), 1, 24) AS tenant FROM documents")
def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    return d.select("doc_id", F.substring(F.md5(F.concat_ws("_", "source", i)), 1, 12).alias("short_id"), F.sha2(F.concat_ws(":", i, F.lit("0"), "text"), 256).alias("chunk_hash"), F.concat(F.lit("user_"), F.substring(F.sha2("source", 256), 1, 24)).alias("tenant"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT 'crossref' AS source, CAST(p_partkey AS VARCHAR) AS id, p_name AS title, '2020' AS year, 'A B' AS authors FROM part UNION ALL SELECT 'openalex', 'x/' || p_partkey, p_name, '2021', 'C' FROM part")
def literature_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    item = F.struct(F.col("p_partkey").cast("string").alias("DOI"), F.array("p_name").alias("title"), F.array(F.struct(F.lit("A").alias("given"), F.lit("B").alias("family"))).alias("author"), F.struct(F.array(F.array(F.lit(2020))).alias("date-parts")).alias("published"))
    one = p.select(F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message"))).alias("body"))
    work = F.struct(F.concat(F.lit("https://doi.org/x/"), F.col("p_partkey").cast("string")).alias("doi"), F.col("p_name").alias("title"), F.lit(2021).alias("publication_year"), F.array(F.struct(F.struct(F.lit("C").alias("display_name")).alias("author"))).alias("authorships"))
    two = p.select(F.to_json(F.struct(F.array(work).alias("results"))).alias("body"))
    both = feeds.crossref(one).unionByName(feeds.openalex(two))
    return both.select("source", "id", "title", "year", F.array_join("authors", ",").alias("authors"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2")
def windowed_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = activity.windowed_activity(table(spark, sf_dir, "events"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r6(F.col("total"), 4).alias("total"))


@query()
def text_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", retrieval.hashed_embedding(F.col("text")).alias("embedding"))


@query("SELECT doc_id FROM documents WHERE source = 'src0' AND doc_id % 3 <> 0")
def stale_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    vector = F.when(F.col("doc_id") % 3 == 1, F.lit(None)).otherwise(F.array(F.lit(1.0))).cast(T.ArrayType(T.DoubleType()))
    chunks = d.select("doc_id", "text", F.col("source").alias("user_sub"), vector.alias("embedding"), F.when(F.col("doc_id") % 3 == 2, "old").otherwise("m1").alias("embedding_model"))
    return retrieval.stale_chunks(chunks, "m1", "src0").select("doc_id")


_NAMED = "WITH m AS (SELECT o_orderkey AS id, list_filter(['temp_degc', 'uv_dose', o_orderpriority], lambda x: NOT (o_orderkey % 4 = 0 OR (o_orderkey % 4 = 1 AND x = 'uv_dose'))) AS sig, (o_orderkey % 1000 - 500) / 8.0 AS b, o_totalprice / 1e6 AS r2, o_orderkey % 3 = 0 AS passed, CASE WHEN o_orderkey % 5 = 0 THEN 'We predict ph_removal in regime 2' WHEN o_orderkey % 5 = 1 THEN 'nothing' END AS description FROM orders) "


@query(
    _NAMED
    + """SELECT id, CASE WHEN len(sig) > 0 THEN 'The strongest statistical signal involves ' || array_to_string(list_transform(list_filter(sig, lambda v: v <> 'uv_dose'), lambda v: v || ' (' || CASE WHEN CASE WHEN v = 'temp_degc' THEN b ELSE 0.5 END >= 0 THEN '+' ELSE '' END || printf('%.3f', CASE WHEN v = 'temp_degc' THEN b ELSE 0.5 END) || ')'), ', ') || ', suggesting these predictors align most closely with the fitted response. ' ELSE '' END
|| 'In-sample fit is moderate (R²=' || printf('%.3f', r2) || ', adj. R²=' || printf('%.3f', r2 / 2) || ') and validation ' || CASE WHEN passed THEN 'passed' ELSE 'did not fully pass' END || '.' || CASE WHEN id % 2 = 0 THEN ' Corpus matches include: first; second.' ELSE '' END AS rationale,
CASE WHEN len(sig) > 0 THEN CASE WHEN id % 4 = 1 THEN 'Temp and ' || replace(substring(sig[2], 1, 3) || lower(substring(sig[2], 4)), ' s', ' S') ELSE 'Temp and Uv Dose' END || CASE WHEN id % 5 = 0 THEN ' Drive Ph Removal' ELSE ' Are Key Predictors' END WHEN id % 5 = 0 THEN 'Multiple Factors Drive Ph Removal' ELSE 'Key Predictors Identified for Degradation Outcome' END AS title FROM m"""
)
def fallback_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rationales and titles of all models from their numbers alone."""
    k = F.col("o_orderkey")
    names = F.filter(F.array(F.lit("temp_degc"), F.lit("uv_dose"), F.col("o_orderpriority")), lambda x: ~((k % 4 == 0) | ((k % 4 == 1) & (x == "uv_dose"))))
    b = F.create_map(F.lit("temp_degc"), (k % 1000 - 500) / 8.0, F.col("o_orderpriority"), F.lit(0.5))
    cited = F.when(k % 2 == 0, F.array(F.lit("first"), F.lit("second"), F.lit("third")))
    r2 = F.col("o_totalprice") / 1e6
    told = F.when(k % 5 == 0, "We predict ph_removal in regime 2").when(k % 5 == 1, "nothing")
    return table(spark, sf_dir, "orders").select(k.alias("id"), tx.fallback_rationale(names, b, r2, r2 / 2, k % 3 == 0, cited).alias("rationale"), tx.fallback_title(names, told).alias("title"))
