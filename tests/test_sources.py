import io
import json
import zipfile

import pytest

from assaygrid.sources import feeds, tables
from assaygrid.streaming import ingest

ROLES = ["Independent"] * 2 + ["", "Dependent"]
NAMES = ["condition", "time_min", "pfoa mg/L", "out (mg/L)"]


def workbook(rows):
    cells = []
    for i, row in enumerate(rows, 1):
        inner = "".join(f'<c r="{chr(64 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(64 + j)}{i}"><v>{v}</v></c>' for j, v in enumerate(row, 1) if v is not None)
        cells.append(f'<row r="{i}">{inner}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(cells)}</sheetData></worksheet>')
    return out.getvalue()


def test_unified_workbook(spark, tmp_path):
    path = tmp_path / "a.xlsx"
    path.write_bytes(workbook([["A study"], ROLES, NAMES, ["c1", 0, 1.5, 2], ["c1", 1, None, 3]]))
    df, roles = tables.read_unified(spark, str(path))
    assert df.columns == ["row_id", "condition", "time_min", "pfoa_mg_l", "out_mg_l"] and df.count() == 2
    assert (roles.entity, roles.time, roles.inputs, roles.outputs) == ("condition", "time_min", ["pfoa_mg_l"], ["out_mg_l"])
    path.write_bytes(workbook([["a", "b"], [1, 2]]))
    with pytest.raises(ValueError):
        tables.read_unified(spark, str(path))


def test_headers():
    assert tables.names_unified(["A (b)", "a b", None, "μ-x", "A_B"]) == ["a_b", "a_b__1", "col", "u_x", "a_b__2"]
    assert tables.infer_header([["Title"], ["id", "time", "dose"], ["1", "2", "3"]]) == 1
    assert [tables.role_of(c) for c in ("Meta", "Dependent", "Independent", "x", None)] == ["metadata", "output", "input", "unknown", "unknown"]
    with pytest.raises(ValueError):
        tables.legacy_layout(["a"] * 5)


def test_delimited_and_cache(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("Dose mg\ty\n 1 \t2\n\t\n3\t4\n")
    df = tables.read_delimited(spark, str(path), sep="\t")
    assert [r["dose_mg"] for r in df.orderBy("row_id").collect() if r["dose_mg"]] == ["1", "3"]
    read = lambda s, p: tables.read_delimited(s, p, sep="\t")
    assert tables.cached(spark, str(path), str(tmp_path / "cache"), read).count() == tables.cached(spark, str(path), str(tmp_path / "cache"), read).count()


def test_feeds(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1</id><title>A  b</title><summary>S</summary><published>2020-01-01</published><author><name>N</name></author></entry><entry><id>x</id><title></title><summary>S</summary></entry></feed>'
    one = lambda body: spark.createDataFrame([(body,)], "body string")
    r = feeds.arxiv(one(atom)).collect()
    assert len(r) == 1 and (r[0]["id"], r[0]["title"], r[0]["year"], r[0]["authors"]) == ("1", "A b", "2020", ["N"])
    work = {"results": [{"id": "w", "doi": "https://doi.org/10.1/x", "title": "T", "abstract_inverted_index": {"b": [1], "a": [0, 2]}}]}
    assert feeds.openalex(one(json.dumps(work))).first()["abstract"] == "a b a"
    europe = {"resultList": {"result": [{"id": "1", "pmid": "7", "title": "T", "authorString": "A, B", "pubYear": "1999"}]}}
    assert feeds.europe_pmc(one(json.dumps(europe))).first()["url"].endswith("/MED/7")
    scholar = {"data": [{"paperId": "p", "title": "T", "abstract": None}, {"paperId": "q", "title": "T", "abstract": "A", "externalIds": {"ArXiv": "9"}}]}
    assert [r["id"] for r in feeds.semantic_scholar(one(json.dumps(scholar))).collect()] == ["q"]
    assert feeds.crossref(one("not json")).count() == 0


def test_incremental_ingest(spark, tmp_path):
    src, sink, mark = (str(tmp_path / n) for n in ("src", "sink", "mark"))
    ddl = "doc_id long, text string"
    spark.createDataFrame([(1, "alpha. " * 10), (2, "beta")], ddl).write.parquet(src)
    ingest.ingest_new(spark, src, sink, mark, spark.createDataFrame([], ddl).schema)
    first = spark.read.parquet(sink).count()
    spark.createDataFrame([(3, "gamma")], ddl).write.mode("append").parquet(src)
    ingest.ingest_new(spark, src, sink, mark, spark.createDataFrame([], ddl).schema)
    assert (first, spark.read.parquet(sink).count()) == (2, 3)


def test_header_above_blank_rows_and_many_data_rows():
    data = [[float(i), f"Supplier#{i}", float(i % 25), 100.5 + i] for i in range(5)]
    names = ["Condition", "Supplier-Name", "Nation (key)", "Balance"]
    above = [["Suppliers of a book", None, None, None], ["Metadata", "Independent", "", "Dependent"]]
    for blank in ([], [[None] * 4], [[None] * 4, ["", " ", None, None]]):
        assert tables.infer_header([*above, names, *blank, *data]) == 2
        assert tables.infer_header([names, *blank, *data]) == 0


def test_words_find_their_places_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None)], "k long, w array<string>")
    index = df.select("k", feeds.to_inverted("w").alias("m"))
    assert {r["k"]: r["m"] for r in index.collect()} == {1: {"b": [0, 2], "a": [1]}, 2: {}, 3: None}
    assert [r["t"] for r in index.orderBy("k").select(feeds.from_inverted("m").alias("t")).collect()] == ["b a b", "", None]
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
