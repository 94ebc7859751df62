"""Candidate models against the corpus: texts made of their columns, searched once each, scores carried back to every model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.functions import text as tx
from assaygrid.operators.retrieval import QUERY_MIN, STRONG_MIN, hashed_embedding, literature_score, top_k
from assaygrid.operators.screening import MIN_R2
from assaygrid.shared import written

#: Models that a grounding shows.
SHOWN = 6


def _names(columns: Column, most: int) -> Column:
    return F.array_join(F.transform(F.slice(columns, 1, most), tx.humanize), ", ")


def effect_query(y: Column, x: Column) -> Column:
    """What a candidate asks the corpus for its score: of its outcome and its first six inputs."""
    return F.concat(F.lit("Effect of "), _names(x, 6), F.lit(" on "), tx.humanize(y), F.lit("."))


def citation_query(y: Column, x: Column) -> Column:
    """What a chosen candidate asks the corpus for a citation: of its outcome and its first five inputs."""
    return F.concat(tx.humanize(y), F.lit(" as a function of "), _names(x, 5))


def search_texts(texts: DataFrame, corpus: DataFrame, k: int, floor: float = QUERY_MIN, embed: Callable[[Column], Column] = hashed_embedding) -> tuple[DataFrame, DataFrame]:
    """(query_id, query) of the distinct texts of column query, and their k nearest of the corpus (doc_id, embedding) as top_k gives them.

    However many rows ask the same, a text becomes a vector once and is searched once. Null texts ask nothing.
    """
    named, _ = written(texts.select("query").where("query is not null").distinct().select(F.monotonically_increasing_id().alias("query_id"), "query", embed(F.col("query")).alias("embedding")), "texts")
    return named.select("query_id", "query"), top_k(named, corpus, k, floor)


def literature_scores(models: DataFrame, corpus: DataFrame, y: str = "y_col", x: str = "x_cols", embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """VR7 for many: models with lit_score, the similarity of the nearest text of the corpus, 0 if none is near enough. Models without an outcome or inputs score 0."""
    asked = models.withColumn("query", effect_query(F.col(y), F.col(x)))
    texts, found = search_texts(asked, corpus, 1, embed=embed)  # a score is the similarity of the nearest
    scores = texts.join(literature_score(found), "query_id").select("query", "lit_score")
    return asked.join(scores, "query", "left").withColumn("lit_score", F.coalesce("lit_score", F.lit(0.0))).drop("query")


def ground_stored(models: DataFrame, corpus: DataFrame, chunks: DataFrame, run: str = "run_id", embed: Callable[[Column], Column] = hashed_embedding, top: int = SHOWN) -> tuple[DataFrame, DataFrame]:
    """SE6: stored models of many runs against the corpus, without fitting: bundles and citations.

    models: a run's column, id, y_col, x_cols, r_squared. Of each run the best by literature times R2, then literature, then R2, of
    the strong ones if there are two, else of all; ties by id. bundles: run, hypothesis_id (H1 ...), id, y_col, primary_variables, r_squared,
    lit_score, priority_score, validation_passed, rationale, warning. citations: run, hypothesis_id, source, title, url,
    similarity_score, snippet of the nearest chunk (doc_id, title, source_file, text) to each bundle's own text, if one is near enough.
    """
    corpus, _ = written(corpus.select("doc_id", "embedding"), "vectors")  # searched twice, made once
    scored, _ = written(literature_scores(models, corpus, embed=embed), "scored")
    strong = scored.groupBy(F.col(run).alias("_run")).agg(F.count_if(F.col("lit_score") >= STRONG_MIN).alias("_strong"))
    both = scored.join(strong, F.col(run).eqNullSafe(F.col("_run"))).where((F.col("_strong") < 2) | (F.col("lit_score") >= STRONG_MIN))
    order = [F.desc(F.col("lit_score") * F.col("r_squared")), F.desc("lit_score"), F.desc("r_squared"), F.col("id")]
    chosen = both.withColumn("rank", F.row_number().over(Window.partitionBy(run).orderBy(*order))).where(F.col("rank") <= top)
    chosen, _ = written(chosen.withColumn("hypothesis_id", F.concat(F.lit("H"), F.col("rank").cast("string"))).withColumn("query", citation_query(F.col("y_col"), F.col("x_cols"))), "chosen")
    rationale = F.format_string("Automated screening fit (OLS or ridge fallback) with in-sample R² %s. Corpus embedding resemblance peak %s%% for a query built from this outcome and predictors.", tx.fixed(F.col("r_squared"), 3), tx.fixed(F.col("lit_score") * 100, 0))
    bundles = chosen.select(
        run,
        "hypothesis_id",
        "id",
        "y_col",
        F.slice("x_cols", 1, 10).alias("primary_variables"),
        F.round("r_squared", 4).alias("r_squared"),
        "lit_score",
        F.round(F.least(F.lit(1.0), F.col("lit_score")), 4).alias("priority_score"),
        ((F.col("r_squared") >= MIN_R2) & (F.col("lit_score") >= STRONG_MIN)).alias("validation_passed"),
        rationale.alias("rationale"),
        F.when(F.col("_strong") == 0, "Corpus similarity was weak for most fits; showing top statistical fits anyway.").alias("warning"),
    )
    texts, found = search_texts(chosen, corpus, 1, embed=embed)
    # cut before the join, which may shuffle them
    shown = chunks.select("doc_id", "title", "source_file", F.trim(F.substring(F.coalesce("text", F.lit("")), 1, 500)).alias("snippet"))
    best = chosen.select(run, "hypothesis_id", "query").join(texts, "query").join(found, "query_id").join(shown, "doc_id")
    citations = best.select(run, "hypothesis_id", F.lit("corpus").alias("source"), F.coalesce("title", "source_file").alias("title"), F.col("source_file").alias("url"), F.round("similarity", 4).alias("similarity_score"), "snippet")
    return bundles, citations
