"""Stored and fitted models against the corpus, and the two ways of searching it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaygrid.operators import grid, literature, retrieval, screening

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letters(text):
    return F.array(*[F.regexp_count(F.lower(text), F.lit(c)).cast("double") for c in LETTERS])


def vector(text):
    return np.array([text.lower().count(c) for c in LETTERS], float)


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["Removal of dye by ozone", "zzz", "", None, "quick wax", "Uptake of lead on clay", "Effect of dose on removal."]
    chunks = spark.createDataFrame([(i, None if i % 2 else f"T{i}", f"f{i}.pdf", t) for i, t in enumerate(texts)], "doc_id long, title string, source_file string, text string")
    return chunks.select("doc_id", letters(F.coalesce("text", F.lit(""))).alias("embedding")), chunks, texts


MODELS = [
    ("run1", 1, "removal_mg_l", ["dose", "uv_dose"], 0.5),
    ("run1", 2, "removal_mg_l", ["dose", "uv_dose"], 0.7),  # the same text
    ("run1", 3, "zz", ["zzz"], 0.01),
    ("run1", 4, None, ["dose"], 0.9),
    ("run2", 5, "123", ["456", "7"], 0.3),  # a text without a letter but those of its frame
    (None, 6, "lead", ["clay"] * 9, 0.4),
    ("run1", 7, "removal", [], 0.2),
]


def test_scores_of_every_model(spark, corpus):
    vectors, _, texts = corpus
    models = spark.createDataFrame(MODELS, "run_id string, id long, y_col string, x_cols array<string>, r_squared double")
    got = {r["id"]: r["lit_score"] for r in literature.literature_scores(models, vectors, embed=letters).collect()}
    asked = {1: "Effect of dose, uv dose on removal.", 2: "Effect of dose, uv dose on removal.", 3: "Effect of zzz on zz.", 5: "Effect of 456, 7 on 123.", 6: "Effect of clay, clay, clay, clay, clay, clay on lead.", 7: "Effect of  on removal."}
    unit = lambda v: v / np.linalg.norm(v)
    for i, text in asked.items():
        best = max(unit(vector(text)) @ unit(vector(t)) for t in texts if t and vector(t).any())
        assert got[i] == pytest.approx(best if best >= 0.18 else 0.0, abs=1e-4)
    assert got[4] == 0.0 and len(got) == len(MODELS)


def test_grounding_of_stored_models(spark, corpus):
    models = spark.createDataFrame(MODELS, "run_id string, id long, y_col string, x_cols array<string>, r_squared double")
    bundles, citations = literature.ground_stored(models, *corpus[:2], embed=letters, top=2)
    rows = {(r["run_id"], r["hypothesis_id"]): r for r in bundles.collect()}
    assert rows["run1", "H1"]["id"] == 2 and rows["run1", "H2"]["id"] == 1 and (None, "H1") in rows and len(rows) == 4
    assert not rows["run2", "H1"]["validation_passed"] or rows["run2", "H1"]["lit_score"] >= 0.30
    cited = {(r["run_id"], r["hypothesis_id"]): r for r in citations.collect()}
    assert cited["run1", "H1"]["snippet"] == cited["run1", "H2"]["snippet"] and cited["run1", "H1"]["title"]
    empty, none = literature.ground_stored(models.where("id > 99"), *corpus[:2], embed=letters)
    assert empty.count() == 0 and none.count() == 0


def test_candidates_are_scored_by_the_corpus(spark, corpus):
    rng = np.random.default_rng(2)
    rows = [(i, i // 10, float(i % 10), *map(float, v), float(v[0] * 2 - v[1] + i % 10 + rng.normal())) for i, v in enumerate(rng.normal(size=(200, 3)))]
    df = spark.createDataFrame(rows, "row_id long, unit int, time double, dose double, clay double, wax double, removal double")
    out, warnings = screening.screen_grounded(df, ["dose", "clay", "wax"], ["removal"], corpus[0], "run", "row_id", entity="unit", time="time", embed=letters, top=12)
    found = {tuple(r["primary_variables"]): r for r in out.collect()}
    assert ("dose", "clay") in found and any(r["model_type"] == "panel_fixed_effects" for r in found.values())
    scores = {tuple(r["x_cols"]): r["lit_score"] for r in literature.literature_scores(spark.createDataFrame([("removal", list(x)) for x in found], "y_col string, x_cols array<string>"), corpus[0], embed=letters).collect()}
    assert {x: r["priority_score"] for x, r in found.items()} == pytest.approx({x: round(min(1.0, s), 4) for x, s in scores.items()})
    assert warnings == [] and screening.screen_grounded(df.limit(5), ["dose", "clay"], ["removal"], corpus[0], "run", "row_id", embed=letters)[1] == ["Fewer than 12 rows in the segment."]


@pytest.mark.parametrize(("queries", "corpus_rows"), [(3, 5), (1000, 7), (40, 10_000)])
def test_tiles_find_what_a_broadcast_finds(spark, monkeypatch, queries, corpus_rows):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", queries)
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", corpus_rows)
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.integers(-2, 3, (60, 5)).astype(float))] + [(70, None), (71, [0.0] * 5), (72, [1.0, 2.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    ask = df.withColumnRenamed("doc_id", "query_id")
    one, two = (sorted(map(tuple, retrieval.top_k(ask, df, 4, 0.1, small=s).collect())) for s in (1 << 20, 0))
    assert one == two and len(one) > 100
    assert retrieval.top_k(ask.limit(0), df, 4, small=0).count() == 0 and retrieval.top_k(ask, df.limit(0), 4).count() == 0


def test_tiles_neither_collect_nor_broadcast(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    plan = retrieval.top_k(e.withColumnRenamed("vec_id", "query_id"), e, 3, doc_id="vec_id", small=0)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan


def test_every_pair_of_tiles_meets_once(spark):
    left = spark.range(30).selectExpr("id", "'l' as v")
    right = spark.range(50).selectExpr("id + 100 as id", "'r' as v")

    def pairs(batches):
        for a, b in grid.cells(batches, held=8):
            import pyarrow as pa

            ids = [(x, y) for x in a["id"].to_pylist() for y in b["id"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in ids], pa.int64()), "b": pa.array([y for _, y in ids], pa.int64())})

    got = [(r["a"], r["b"]) for r in grid.met(left, right, "id", 4, 9).mapInArrow(pairs, "a long, b long").collect()]
    assert sorted(got) == [(a, b) for a in range(30) for b in range(100, 150)]


def test_vectors_of_the_corpus_are_made_once(spark, corpus):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counted(text):
        made.add(1)
        return [float(len(text)), 1.0, 2.0]

    docs = spark.range(40, numPartitions=2).selectExpr("id as doc_id", "repeat('a', cast(id as int) + 1) as text").select("doc_id", counted("text").alias("embedding"))
    chunks = spark.range(40).selectExpr("id as doc_id", "'t' as title", "'f' as source_file", "repeat(' x', 400) as text")
    models = spark.createDataFrame(MODELS, "run_id string, id long, y_col string, x_cols array<string>, r_squared double")
    _, citations = literature.ground_stored(models, docs, chunks, embed=lambda t: F.array(F.length(t).cast("double"), F.lit(1.0), F.lit(2.0)))
    assert {r["snippet"] for r in citations.collect()} == {("x " * 250)[:-1]} and made.value == 40


def test_unsound_vectors_match_nothing(spark):
    ask = spark.createDataFrame([(1, [1.0, 0.0]), (2, [None, 1.0]), (3, None), (4, [float("inf"), 1.0]), (5, [float("nan"), 1.0]), (6, [0.0, 0.0])], "query_id long, embedding array<double>")
    docs = ask.withColumnRenamed("query_id", "doc_id")
    for small in (1 << 20, 0):
        assert [tuple(r) for r in retrieval.top_k(ask, docs, 3, small=small).collect()] == [(1, 1, 1.0, 1)]


def test_rows_of_a_grounded_screening_are_computed_once(spark, corpus):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        made.add(1)
        return v

    rng = np.random.default_rng(6)
    rows = [(i, *map(float, v), float(v[0] * 2 - v[1] + rng.normal())) for i, v in enumerate(rng.normal(size=(120, 2)))]
    df = spark.createDataFrame(rows, "row_id long, dose double, clay double, removal double").withColumn("dose", counted("dose"))
    out, _ = screening.screen_grounded(df, ["dose", "clay"], ["removal"], corpus[0], "run", "row_id", embed=letters)
    assert out.count() == 1 and made.value == 120
