"""Queries that search the corpus: all rows against all rows, and stored models grounded in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.operators import literature, retrieval, screening
from assaygrid.plans.registry import query, table
from assaygrid.plans.served import _COS
from assaygrid.plans.tabular import experiment, r6

#: Letters whose counts are a text's vector here, where SQL must make the same.
LETTERS = "bgkpuvwxyz"
_LETTERS = "[" + ", ".join(f"CAST(length(lower({{0}})) - length(replace(lower({{0}}), '{c}', '')) AS DOUBLE)" for c in LETTERS) + "]"


def letter_counts(text: Column) -> Column:
    # an array of one text, so that it is made lower case once
    counts = lambda t: F.array(*[(F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])
    return F.transform(F.array(F.lower(text)), counts)[0]


@query(f"SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round({_COS}, 4) + 0.0 AS similarity, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 12) DESC, d.vec_id) AS INTEGER) AS rank FROM embeddings q, embeddings d QUALIFY rank <= 4")
def vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row against all rows, tile by tile."""
    e = table(spark, sf_dir, "embeddings")
    found = retrieval.top_k(e.withColumnRenamed("vec_id", "query_id"), e, 4, doc_id="vec_id", small=0)
    return found.select("query_id", "doc_id", r6(F.col("similarity"), 4).alias("similarity"), "rank")


_STORED = f"""
WITH stored AS (SELECT CAST(p_size % 10 AS VARCHAR) AS run_id, p_partkey AS id, lower(p_type) || '_mg_l' AS y_col, string_split(p_name, ' ') AS x_cols, p_retailprice / 2500 AS r_squared FROM part),
asked AS (SELECT *, 'Effect of ' || array_to_string(x_cols, ', ') || ' on ' || lower(split_part(y_col, '_', 1)) || '.' AS query FROM stored),
corpus AS (SELECT doc_id, source, text, {_LETTERS.format("text")} AS v FROM documents WHERE text IS NOT NULL),
texts AS (SELECT query, {_LETTERS.format("query")} AS v FROM (SELECT DISTINCT query FROM asked)),
near AS (SELECT query, max(round(list_cosine_similarity(t.v, c.v), 4)) AS s FROM texts t JOIN corpus c ON list_sum(t.v) > 0 AND list_sum(c.v) > 0 GROUP BY query),
scored AS (SELECT a.*, CASE WHEN s >= 0.18 THEN s ELSE 0.0 END AS lit_score FROM asked a LEFT JOIN near USING (query)),
strong AS (SELECT *, count(*) FILTER (WHERE lit_score >= 0.3) OVER (PARTITION BY run_id) AS n FROM scored),
chosen AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY lit_score * r_squared DESC, lit_score DESC, r_squared DESC, id) AS rank FROM strong WHERE n < 2 OR lit_score >= 0.3 QUALIFY rank <= 6)
"""


def stored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as stored models of ten runs: outcome by type, inputs by the words of a name."""
    return table(spark, sf_dir, "part").select((F.col("p_size") % 10).cast("string").alias("run_id"), F.col("p_partkey").alias("id"), F.concat(F.lower("p_type"), F.lit("_mg_l")).alias("y_col"), F.split("p_name", " ").alias("x_cols"), (F.col("p_retailprice") / 2500).alias("r_squared"))


def letter_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, embedding) and (doc_id, title, source_file, text) of all documents with text."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", letter_counts(F.col("text")).alias("embedding")), d.select("doc_id", F.lit(None).cast("string").alias("title"), F.col("source").alias("source_file"), "text")


@query(_STORED + "SELECT run_id, id, lit_score + 0.0 AS lit_score FROM scored")
def literature_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored model with the similarity of the nearest document; equal texts are searched once."""
    return literature.literature_scores(stored_models(spark, sf_dir), letter_corpus(spark, sf_dir)[0], embed=letter_counts).select("run_id", "id", r6(F.col("lit_score"), 4).alias("lit_score"))


@query(_STORED + "SELECT run_id, 'H' || rank AS hypothesis_id, id, y_col, array_to_string(x_cols, ',') AS inputs, round(r_squared, 4) + 0.0 AS r_squared, lit_score + 0.0 AS priority_score, r_squared >= 0.06 AND lit_score >= 0.3 AS validation_passed FROM chosen")
def stored_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best stored models of every run as bundles, without fitting anything."""
    bundles, _ = literature.ground_stored(stored_models(spark, sf_dir), *letter_corpus(spark, sf_dir), embed=letter_counts)
    return bundles.select("run_id", "hypothesis_id", "id", "y_col", F.array_join("primary_variables", ",").alias("inputs"), r6(F.col("r_squared"), 4).alias("r_squared"), r6(F.col("priority_score"), 4).alias("priority_score"), "validation_passed")


@query(
    _STORED
    + f""", cites AS (SELECT DISTINCT query, v FROM (SELECT lower(split_part(y_col, '_', 1)) || ' as a function of ' || array_to_string(x_cols, ', ') AS query, {_LETTERS.format("lower(split_part(y_col, '_', 1)) || ' as a function of ' || array_to_string(x_cols, ', ')")} AS v FROM chosen)),
best AS (SELECT query, doc_id, source, text, list_cosine_similarity(t.v, c.v) AS s FROM cites t JOIN corpus c ON list_sum(t.v) > 0 AND list_sum(c.v) > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(s, 12) DESC, doc_id) = 1)
SELECT run_id, 'H' || rank AS hypothesis_id, source AS url, round(s, 4) + 0.0 AS similarity_score, length(trim(substring(text, 1, 500), ' ')) AS snippet_length FROM chosen c JOIN best b ON b.query = lower(split_part(y_col, '_', 1)) || ' as a function of ' || array_to_string(x_cols, ', ') WHERE s >= 0.18"""
)
def stored_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest document of each chosen model, by a text of its own."""
    _, citations = literature.ground_stored(stored_models(spark, sf_dir), *letter_corpus(spark, sf_dir), embed=letter_counts)
    return citations.select("run_id", "hypothesis_id", "url", r6(F.col("similarity_score"), 4).alias("similarity_score"), F.length("snippet").cast("long").alias("snippet_length"))


_GROUNDED = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]


@query()
def grounded_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates fitted, diagnosed in the order of lines, and scored by what the documents hold nearest to them; the best as bundles."""
    rows = experiment(spark, sf_dir).withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return screening.screen_grounded(rows, _GROUNDED, ["response"], letter_corpus(spark, sf_dir)[0], "run", "row_id", embed=letter_counts)[0]
