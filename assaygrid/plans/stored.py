"""Queries over what is kept and what comes as workbooks: rollups that follow their tables, workbooks read by executors, statistics in SQL."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.functions.sql import grams, register_statistics
from assaygrid.operators import results, rollups
from assaygrid.plans.registry import query, table
from assaygrid.plans.served import MODELS, store
from assaygrid.plans.tabular import r6
from assaygrid.shared import fresh_path
from assaygrid.sources import workbooks


@query(MODELS + "SELECT run_id, round, round(avg(match_score), 6) + 0.0 AS avg_match, round(max(r_squared), 6) + 0.0 AS max_r2, count(*) AS n_models, count(*) FILTER (WHERE overall_passed) AS n_passed FROM h JOIN m ON h.id = hypothesis_id LEFT JOIN v ON model_result_id = m.id WHERE run_id <> '7' GROUP BY 1, 2")
def kept_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup after a first load, an insert of the other models, a deleted run and a compaction: as the full query has it."""
    s = store(spark, sf_dir)
    models = s["model_results"]
    kept = rollups.Rollup(spark, fresh_path(spark, "rollup"))
    early = models.where("id % 4 <> 0")
    kept.replace(rollups.partials(s["hypotheses"], early, s["validation_results"]), s["runs"].selectExpr("id AS run_id"))
    kept.insert(rollups.partials(s["hypotheses"], models.where("id % 4 = 0"), s["validation_results"]))
    kept.delete(s["runs"].where("id = '7'").selectExpr("id AS run_id"))
    kept.compact()
    return kept.read().select("run_id", "round", r6(F.col("avg_match")).alias("avg_match"), r6(F.col("max_r2")).alias("max_r2"), "n_models", "n_passed")


def workbook_bytes(rows: list[list[object]]) -> bytes:
    """A workbook of one sheet with strings in cells and numbers as they are."""
    from xml.sax.saxutils import escape

    letter = lambda j: (letter(j // 26 - 1) if j >= 26 else "") + chr(65 + j % 26)
    cells = []
    for i, row in enumerate(rows, 1):
        each = (f'<c r="{letter(j)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' if isinstance(v, str) else f'<c r="{letter(j)}{i}"><v>{v!r}</v></c>' for j, v in enumerate(row) if v is not None)
        cells.append(f'<row r="{i}">{"".join(each)}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(cells)}</sheetData></worksheet>')
    return out.getvalue()


#: Workbooks that suppliers are dealt to.
BOOKS = 200


def _books(spark: SparkSession, sf_dir: str) -> str:
    """Suppliers as workbooks with a row of roles above a row of names, written by executors."""
    folder = fresh_path(spark, "books")
    s = table(spark, sf_dir, "supplier").select(F.pmod("s_suppkey", F.lit(BOOKS)).alias("book"), "s_suppkey", "s_name", "s_nationkey", "s_acctbal")

    def written(key, frame):
        import pandas as pd

        # some lines of text come first
        rows = [*[["Suppliers of a book"]] * (1 + key[0] % 3), ["Metadata", "Independent", "", "Dependent"], ["Condition", " Supplier-Name", "Nation (key)", "Balance"], [None, None, None, None]]
        rows += [[float(r.s_suppkey), f" {r.s_name} ", float(r.s_nationkey), float(r.s_acctbal)] for r in frame.sort_values("s_suppkey").itertuples()]
        out, at = workbooks.open_store(folder)
        out.create_dir(at, recursive=True)
        with out.open_output_stream(f"{at}/book-{key[0]:04}.xlsx") as f:
            f.write(workbook_bytes(rows))
        return pd.DataFrame({"book": [key[0]]})

    s.groupBy("book").applyInPandas(written, "book long").count()
    return folder


@query("SELECT 'book-' || lpad(CAST(s_suppkey % 200 AS VARCHAR), 4, '0') || '.xlsx' AS file, row_number() OVER (PARTITION BY s_suppkey % 200 ORDER BY s_suppkey) AS row_id, CAST(s_suppkey AS VARCHAR) AS condition, s_name AS supplier_name, CAST(s_nationkey AS INTEGER) AS nation_key, round(s_acctbal, 2) + 0.0 AS balance FROM supplier")
def workbook_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of workbooks, each read by a task of its own."""
    b = workbooks.read_workbooks(spark, _books(spark, sf_dir))
    return b.select("file", "row_id", "condition", "supplier_name", F.col("nation_key").cast("int").alias("nation_key"), r6(F.col("balance").cast("double"), 2).alias("balance"))


_BOOK = "SELECT DISTINCT s_suppkey % 200 AS book, 'book-' || lpad(CAST(s_suppkey % 200 AS VARCHAR), 4, '0') || '.xlsx' AS file FROM supplier"


@query(f"SELECT file, CAST(1 + book % 3 AS INTEGER) AS pair, 'condition,supplier_name,nation_key,balance' AS names, 'metadata,input,input,output' AS roles, 'supplier_name,nation_key' AS inputs, 'balance' AS outputs, 'condition' AS entity FROM ({_BOOK})")
def header_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each workbook of a folder declares, whatever lines stand above it."""
    h = workbooks.headers(spark, _books(spark, sf_dir))
    text = lambda c: F.array_join(c, ",").alias(c)
    return h.select("file", "pair", text("names"), text("roles"), text("inputs"), text("outputs"), "entity")


@query(f"SELECT file, CAST(2 + book % 3 AS INTEGER) AS smart, 'condition,supplier_name,nation_key,balance' AS smart_names FROM ({_BOOK})")
def inferred_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header row of each workbook by its looks."""
    return workbooks.headers(spark, _books(spark, sf_dir)).select("file", "smart", F.array_join("smart_names", ",").alias("smart_names"))


_SUMS = "SELECT l_suppkey, CAST(count(*) AS DOUBLE) AS n, sum(l_discount) AS sx, sum(l_extendedprice) AS sy, sum(l_discount * l_discount) AS sxx, sum(l_discount * l_extendedprice) AS sxy, sum(l_extendedprice * l_extendedprice) AS syy FROM lineitem GROUP BY 1"


@query(f"SELECT l_suppkey, n, round(sx, 4) + 0.0 AS sx, round(sxx, 4) + 0.0 AS sxx, round(sxy, 4) + 0.0 AS sxy, round(syy / 1e6, 2) + 0.0 AS syy FROM ({_SUMS})")
def sql_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Gram matrix of each supplier's lines by registered aggregates, slices first."""
    register_statistics(spark)
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("gram_lines")
    m = spark.sql("SELECT l_suppkey, gram_sum(g) AS m FROM (SELECT l_suppkey, gram(array(1D, CAST(l_discount AS DOUBLE), CAST(l_extendedprice AS DOUBLE))) AS g FROM gram_lines GROUP BY l_suppkey, pmod(l_orderkey, 8)) GROUP BY l_suppkey")
    at = lambda i, digits, by=1.0: r6(F.col("m")[i] / by, digits)
    return m.select("l_suppkey", F.col("m")[0].alias("n"), at(1, 4).alias("sx"), at(4, 4).alias("sxx"), at(5, 4).alias("sxy"), at(8, 2, 1e6).alias("syy"))


@query(f"WITH s AS ({_SUMS}), c AS (SELECT *, sxx - sx * sx / n AS xx, sxy - sx * sy / n AS xy, syy - sy * sy / n AS yy FROM s) SELECT l_suppkey, round(xy / xx, 3) + 0.0 AS slope, round(xy / xx / sqrt((yy - xy * xy / xx) / (n - 2) / xx), 5) + 0.0 AS t, TRUE AS tails_agree FROM c")
def sql_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes by supplier with p-values of t and of F in SQL, which agree as t squared is F."""
    register_statistics(spark)
    grams(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_discount", "l_extendedprice"]).createOrReplaceTempView("supplier_grams")
    return spark.sql("""
      WITH c AS (SELECT l_suppkey, gram[0] AS n, gram[4] - gram[1] * gram[1] / gram[0] AS xx, gram[5] - gram[1] * gram[2] / gram[0] AS xy, gram[8] - gram[2] * gram[2] / gram[0] AS yy FROM supplier_grams),
      f AS (SELECT *, xy / xx / sqrt((yy - xy * xy / xx) / (n - 2) / xx) AS t FROM c)
      SELECT l_suppkey, round(xy / xx, 3) + 0D AS slope, round(t, 5) + 0D AS t, abs(t_sf(t, n - 2) - f_sf(t * t, 1, n - 2)) < 1e-10 AS tails_agree FROM f""")


@query()
def sql_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of short series in SQL: each user's daily values in order, for a unit root and for normality."""
    register_statistics(spark)
    table(spark, sf_dir, "events").createOrReplaceTempView("test_events")
    return spark.sql("""
      SELECT user_id, size(v) AS n, adf_p(v) AS adf_p, shapiro_p(v) AS shapiro_p
      FROM (SELECT user_id, transform(array_sort(collect_list(struct(ts, value))), x -> CAST(x.value AS DOUBLE)) AS v FROM test_events GROUP BY user_id)""")


_SAID = "The initial dose of the catalyst reduces the removal of every compound in these runs."


@query(
    MODELS
    + f""", g AS (SELECT CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_nationkey % 3 <> 0 AND n_regionkey % 2 = 1), f AS (SELECT hypothesis_id, min(id) AS id FROM m GROUP BY 1), c AS (SELECT l_orderkey AS id, count(*) AS n, max(l_discount) AS top FROM lineitem GROUP BY 1)
SELECT run_id, h.id, round, CASE WHEN h.id % 2 = 0 THEN '{_SAID}' WHEN h.id % 5 = 0 THEN 'Selected predictors are associated with the screened outcome in this regime.' ELSE 'price, key are associated with the screened outcome in this regime.' END AS description,
CASE WHEN h.id % 2 = 0 THEN '{_SAID}' END AS rationale, f.id AS model_id, round(r_squared, 6) + 0.0 AS r_squared, coalesce(overall_passed, FALSE) AS validation_passed, coalesce(n, 0) AS n_citations, round(top, 4) + 0.0 AS top_similarity
FROM h JOIN g ON g.id = run_id JOIN f ON f.hypothesis_id = h.id JOIN m ON m.id = f.id LEFT JOIN v ON model_result_id = f.id LEFT JOIN c ON c.id = f.id WHERE h.id % 7 <> 0"""
)
def saved_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's grounded runs read back: hypotheses with cleaned texts, their first models and citations."""
    s = store(spark, sf_dir)
    runs = s["runs"].withColumn("config_snapshot", F.to_json(F.struct(F.when(F.col("id").cast("int") % 3 == 0, "stats_completed").otherwise(results.GROUNDED).alias("screening_phase"))))
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Output: "), F.lit(_SAID))).otherwise("???")
    names = F.when(F.col("id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("price"), F.lit("key")))
    support = F.when(F.col("id") % 7 == 0, F.array(F.lit("a note"), F.lit('{"_stats_meta": {"n": 1}}'))).when(F.col("id") % 7 == 1, F.array(F.lit('{"_stats_meta": {}}')))
    hypotheses = s["hypotheses"].withColumns({"description": text, "rationale": text, "primary_variables": names, "rag_support": support})
    out = results.grounded_bundles(runs, hypotheses, s["model_results"], s["validation_results"].withColumn("id", F.col("model_result_id")), s["citations"], "user_1")
    top = F.array_max(F.transform("citations", lambda c: c["similarity_score"]))
    return out.select("run_id", "id", "round", "description", "rationale", F.col("model.id").alias("model_id"), r6(F.col("model.r_squared")).alias("r_squared"), "validation_passed", F.size("citations").cast("long").alias("n_citations"), r6(top, 4).alias("top_similarity"))
