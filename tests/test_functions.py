import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaygrid.functions import stats
from assaygrid.functions import text as tx


@pytest.mark.parametrize(("got", "want"), [(stats.t_sf2(2.228, 10), 0.05), (stats.chi2_sf(3.841, 1), 0.05), (stats.f_sf(4.1, 2, 10), 0.0501), (stats.normal_cdf(1.959964), 0.975), (stats.t_quantile(0.975, 10), 2.228)])
def test_tails(got, want):
    assert got == pytest.approx(want, abs=2e-4)


def test_tails_at_their_ends():
    assert stats.t_sf2(math.inf, 3) == 0 and stats.f_sf(-1, 2, 3) == 1 and math.isnan(stats.chi2_sf(1, 0))


def test_series_and_normality():
    rng = np.random.default_rng(1)
    noise = rng.normal(size=300)
    assert stats.adf(noise)[1] < 0.01 < 0.05 < stats.adf(np.cumsum(noise))[1]
    assert stats.shapiro(noise)[1] > 0.05 > stats.shapiro(np.exp(2 * noise))[1]
    assert all(map(math.isnan, stats.adf(np.ones(20)))) and math.isnan(stats.shapiro(np.ones(5))[0])
    assert stats.normal_test(500, 0.0, 0.0)[1] > 0.5 > stats.normal_test(500, 2.0, 6.0)[1]


def test_shapiro_by_published_values():
    """Known W and p: Shapiro and Wilk's weights of eleven men; speeds of fifty cars; three values in closed form."""
    w, p = stats.shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))
    assert (round(w, 4), round(p, 4)) == (0.7888, 0.0067)
    counts = {4: 2, 7: 2, 8: 1, 9: 1, 10: 3, 11: 2, 12: 4, 13: 4, 14: 4, 15: 3, 16: 2, 17: 3, 18: 4, 19: 3, 20: 5, 22: 1, 23: 1, 24: 4, 25: 1}
    w, p = stats.shapiro(np.repeat(list(counts), list(counts.values())))
    assert (round(w, 5), round(p, 4)) == (0.97765, 0.4576)
    w, p = stats.shapiro(np.array([1.0, 2.0, 3.0]))
    assert w == pytest.approx(1) and p == pytest.approx(1)
    w, p = stats.shapiro(np.array([0.0, 0.0, 1.0]))
    assert w == pytest.approx(0.75) and p == pytest.approx(0, abs=1e-6)
    for n in (4, 5, 6, 11, 12):  # even quantiles look normal, one far value does not
        even = np.array([stats.normal_quantile((i + 0.5) / n) for i in range(n)])
        assert stats.shapiro(even)[1] > 0.5 > 0.01 > stats.shapiro(np.append(even[:-1], 1e3))[1]
    assert all(math.isnan(stats.shapiro(np.array(v))[0]) for v in ([], [1.0, 2.0], [3.0] * 8))


def test_embedding_of_words(spark):
    import xxhash

    from assaygrid.operators.retrieval import hashed_embedding

    texts = ["Water and water, treated 2 ways", "", None, "one", " ".join(f"w{i}" for i in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in df.select("i", hashed_embedding(F.col("text")).alias("v")).collect():
        want = np.zeros(64)
        for word in (texts[r["i"]] or "").lower().split():
            want[xxhash.xxh64_intdigest(word, 42) % 64] += 1
        size = np.linalg.norm(want)
        assert r["v"] == pytest.approx((want / size if size else want).tolist(), abs=1e-6)


CASES = [
    ("The treatment reduces the outcome across all tested conditions.", True),
    ("we need to find what drives the outcome across conditions.", False),
    ("Short one.", False),
    ("narudi narudi narudi narudi narudi narudi narudi", False),
    ("This sentence has ))) far too much punctuation for good prose.", False),
    ("Visit https://example.org for all of the details about outcomes.", False),
    ("Größenänderungen führen überall zu äußerst ähnlichen Übergängen hier.", False),
    (None, False),
    ("", False),
]


def test_clean_sentence(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: r["ok"] for r in df.select("i", tx.is_clean_sentence(F.col("t")).alias("ok")).collect()}
    assert [got[i] for i in range(len(CASES))] == [ok for _, ok in CASES]


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_clean_paragraph(spark):
    sentence = "The initial dose drives the removal of all compounds in these runs."
    cases = [
        (sentence, True),
        (f"{sentence} A longer time leaves less of the parent compound behind.", True),
        (f"{sentence} Done.", False),
        (f"{sentence} Very good.", False),
        (f"{sentence} It really helps.", True),
        ("The dose matters: the time matters: the catalyst matters: all of them drive removal.", False),
        ("The dose matters: the time matters: all of these inputs drive the removal here.", True),
        ("???", False),
        (None, False),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["ok"] for r in df.select("i", tx.is_clean_paragraph(F.col("t")).alias("ok")).collect()}
    assert [got[i] for i in range(len(cases))] == [ok for _, ok in cases]


def test_titles_and_answers(spark):
    assert one(spark, tx.is_clean_title, "Initial Dose Drives Removal Of Compounds")
    assert not one(spark, tx.is_clean_title, "What Drives Removal Of These Compounds?")
    assert not one(spark, tx.is_clean_title, "dose drives removal of many compounds")
    assert not one(spark, tx.is_clean_title, "a b c")
    assert one(spark, tx.strip_label, "Title: A thing") == "A thing"
    answer = "<think>hm</think> The initial dose drives the removal of all compounds. The second input has no effect on any outcome here."
    assert one(spark, tx.strip_thinking, answer).startswith("The initial dose drives")
    assert one(spark, tx.truncate_references, "body\nReferences\n[1] x") == "body"
    assert one(spark, tx.is_reference_chunk, "[1] a [2] b [3] c [4] d [5] e")
    assert not one(spark, tx.is_reference_chunk, "")
    assert one(spark, tx.keyword_terms, "uv_intensity of the uv lamp rate") == ["intensity", "the", "lamp"]
    assert one(spark, tx.is_clean_domain, "Domain: advanced water treatment") and not one(spark, tx.is_clean_domain, "unknown dataset")


def test_fallback_texts(spark):
    from pyspark.sql import functions as F

    from assaygrid.functions import text as tx

    one = lambda *columns: spark.range(1).select(*columns).first()
    words = lambda *v: F.array(*[F.lit(x) for x in v])
    none = F.lit(None).cast("array<string>")
    assert one(tx.fallback_title(words("uv_dose_mg_l", "max_ph", "x"), F.lit("We Predict yield_pct in regime 3.")))[0] == "Uv Dose And Max Ph Drive Yield".replace(" And ", " and ")
    assert one(tx.fallback_title(none, F.lit("predict a in regime b")), tx.fallback_title(words("a_b"), F.lit(None)), tx.fallback_title(none, F.lit("no"))) == ("Multiple Factors Drive A", "A B Are Key Predictors", tx.NO_TITLE)
    b = F.create_map(F.lit("a"), F.lit(-1.23456), F.lit("b"), F.lit(2.0))
    got = one(tx.fallback_rationale(words("a", "gone", "b"), b, F.lit(0.5), F.lit(0.25), F.lit(False), words("T" * 200, "u", "v")))[0]
    assert got == f"The strongest statistical signal involves a (-1.235), b (+2.000), suggesting these predictors align most closely with the fitted response. In-sample fit is moderate (R²=0.500, adj. R²=0.250) and validation did not fully pass. Corpus matches include: {'T' * 120}; u."
    assert one(tx.fallback_rationale(none, b, F.lit(0.5), F.lit(0.25), F.lit(True), none))[0] == "In-sample fit is moderate (R²=0.500, adj. R²=0.250) and validation passed."
    n = [F.lit(x) for x in (12, 340)]
    assert one(tx.fallback_summary(*n, F.lit("batch"), F.lit(3), F.lit(True), F.lit(0.876), F.lit(4), F.lit(2), words("a", "b"), F.lit(7)))[0] == "The system analyzed 12 experiments (340 observations) from a batch dataset across 3 rounds of autonomous hypothesis testing. The pipeline converged with a match score of 0.88. 4 statistically significant parameter effects were identified across 2 response variables. Key variables: a, b. Results were grounded against 7 literature sources."
    assert one(tx.fallback_finding(F.lit("dose"), F.lit("positive"), none, F.lit(0.5)))[0] == "dose showed a positive and statistically significant effect on the outcome, consistent across 50% of tested outputs."


def test_numbers_are_rounded_as_c_does(spark):
    from assaygrid.functions import text as tx

    v = [0.2975, 0.0005, 0.0015, 2.5, -2.5, 0.125, -0.0001, 1e-9, 123456789.0625, 0.2985, 1.0005, -0.29750000000000004, 0.0]
    got = spark.createDataFrame([(x,) for x in v], "x double").select("x", *[tx.fixed(F.col("x"), k) for k in (0, 2, 3)]).collect()
    assert [tuple(r)[1:] for r in got] == [tuple(f"{r[0]:.{k}f}" for k in (0, 2, 3)) for r in got]
    assert spark.range(1).select(tx.fixed(F.lit(float("nan")), 3), tx.fixed(F.lit(None).cast("double"), 3)).first() == ("NaN", "null")
    none = F.lit(None).cast("array<string>")
    said = tx.fallback_rationale(none, F.create_map(F.lit("a"), F.lit(1.0)), F.lit(0.2975), F.lit(0.25), F.lit(True), none)
    assert "(R²=0.297, adj. R²=0.250)" in spark.range(1).select(said).first()[0]
