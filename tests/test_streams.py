"""Streams over several calls: equal texts once ever, late rows, open windows, and progress."""

import datetime as dt

import pytest

from assaygrid.streaming import activity, ingest, progress

DOC = "doc_id long, text string"
EVENT = "ts timestamp, user_id long, event_type string, value double"


def put(spark, rows, ddl, path):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("within", [None, "30 days"])
def test_texts_are_stored_once_over_calls(spark, tmp_path, within):
    src, sink, papers, mark = (str(tmp_path / x) for x in ("in", "out", "papers", "state"))
    schema = spark.createDataFrame([], DOC).schema
    run = lambda: ingest.ingest_new(spark, src, sink, mark, schema, papers=papers, within=within)
    put(spark, [(1, "one text"), (2, "two texts"), (3, "one text"), (4, None), (5, "")], DOC, src)
    run()
    put(spark, [(6, "two texts"), (7, "three texts"), (8, None)], DOC, src)
    run()
    run()  # nothing new
    put(spark, [(9, "three texts"), (10, "one text")], DOC, src)
    run()
    stored = spark.read.parquet(papers).collect()
    assert len(stored) == len({r["content_hash"] for r in stored}) == 4  # null and empty texts are one
    texts = [r["text"] for r in spark.read.parquet(sink).collect()]
    assert sorted(texts) == ["one text", "three texts", "two texts"]
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    """A call that failed after it wrote, before its commit: the batch runs again and leaves each text once."""
    src, sink, papers, mark = (tmp_path / x for x in ("in", "out", "papers", "state"))
    schema = spark.createDataFrame([], DOC).schema
    put(spark, [(1, "one"), (2, "two")], DOC, str(src))
    ingest.ingest_new(spark, str(src), str(sink), str(mark), schema, papers=str(papers))
    for f in (mark / "commits").glob("*"):
        if f.name.lstrip(".").startswith("0"):
            f.unlink()
    ingest.ingest_new(spark, str(src), str(sink), str(mark), schema, papers=str(papers))
    assert sorted(r["text"] for r in spark.read.parquet(str(sink)).collect()) == ["one", "two"]
    assert spark.read.parquet(str(papers)).count() == 2


def at(hour, minute):
    return dt.datetime(2024, 1, 1, hour, minute)


def test_late_rows(spark, tmp_path):
    """Ten minutes late is in time; a row for a window that is closed is dropped; the last window waits for the end."""
    src, sink, mark = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = spark.createDataFrame([], EVENT).schema
    run = lambda: activity.run_activity(spark, src, sink, mark, schema)
    put(spark, [(at(10, 5), 1, "a", 1.0), (at(10, 55), 1, "a", 2.0)], EVENT, src)
    assert run().count() == 0
    put(spark, [(at(11, 5), 1, "a", 4.0)], EVENT, src)  # the watermark is 10:55
    run()
    put(spark, [(at(10, 56), 1, "a", 8.0)], EVENT, src)
    assert run().count() == 0  # still open
    put(spark, [(at(11, 30), 1, "a", 16.0)], EVENT, src)
    run()
    put(spark, [(at(10, 59), 1, "a", 32.0), (at(11, 40), 2, "a", None)], EVENT, src)  # the first window is closed
    out = {r["start"].hour: (r["n"], r["total"]) for r in run().collect()}
    assert out == {10: (3, 11.0)}
    activity.close_windows(spark, src, schema)
    out = {r["start"].hour: (r["n"], r["total"]) for r in run().collect()}
    assert out == {10: (3, 11.0), 11: (3, 20.0)}


def test_sessions_merge_over_files(spark, tmp_path):
    src, sink, mark = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = spark.createDataFrame([], EVENT).schema
    how = {"of": activity.sessions, "gap": "20 minutes", "late": "30 minutes"}
    put(spark, [(at(10, 0), 1, "a", 1.0), (at(10, 30), 1, "a", 2.0), (at(10, 0), 2, "a", 1.0)], EVENT, src)
    activity.run_activity(spark, src, sink, mark, schema, **how)
    put(spark, [(at(10, 15), 1, "a", 4.0)], EVENT, src)  # joins the two
    activity.run_activity(spark, src, sink, mark, schema, **how)
    activity.close_windows(spark, src, schema)
    got = {(r["user_id"], r["start"].minute, r["end"].minute, r["n"], r["total"]) for r in activity.run_activity(spark, src, sink, mark, schema, **how).collect()}
    assert got == {(1, 0, 50, 3, 7.0), (2, 0, 20, 1, 1.0)}


@pytest.mark.parametrize(("pct", "elapsed", "done", "want"), [(5, 10.0, False, None), (50, 10.0, False, 10), (50, 10.0, True, None), (99, 1.0, False, 1), (6, 0.0, False, None), (30, 9.0, False, 21)])
def test_estimates(pct, elapsed, done, want):
    assert progress.eta_seconds(pct, elapsed, done) == want


def test_progress_of_a_job(spark, tmp_path):
    src, sink, mark, log = (str(tmp_path / x) for x in ("in", "out", "state", "log"))
    schema = spark.createDataFrame([], DOC).schema
    for k in range(3):
        put(spark, [(10 * k + i, f"text {k} {i}") for i in range(4)], DOC, src)
    with progress.ProgressLog(spark, "job", log, total_rows=12):
        ingest.ingest_new(spark, src, sink, mark, schema, name="job", files=1)
        ingest.ingest_new(spark, src, sink + "2", mark + "2", schema)  # another job's
    rows = sorted(progress.progress(spark, log).collect(), key=lambda r: (r["done"], r["rows_so_far"]))
    assert [(r["batch"], r["rows_in"], r["rows_so_far"], r["pct"], r["done"]) for r in rows] == [(0, 4, 4, 33, False), (1, 4, 8, 66, False), (2, 4, 12, 99, False), (None, 0, 12, 100, True)]
    assert all(r["eta_seconds"] >= 1 for r in rows[:-1]) and rows[-1]["eta_seconds"] is None and all(r["seconds"] > 0 for r in rows)


def test_a_failed_job_says_so(spark, tmp_path):
    log = str(tmp_path / "log")
    with pytest.raises(ValueError), progress.ProgressLog(spark, "job", log, wait=1.0):
        raise ValueError("no such corpus")
    row = progress.progress(spark, log).first()
    assert not row["done"] and row["error"] == "no such corpus"


def test_documents_are_fed_by_as_many_tasks_as_read_them(spark, tmp_path):
    from assaygrid.plans import streams

    spark.range(40).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in kept:
        spark.conf.set(k, "1k")
    try:
        base = streams._fed_documents(spark, str(tmp_path))
        assert spark.read.parquet(f"{base}/in").select("_metadata.file_name").distinct().count() > streams.FILES
        assert spark.read.parquet(f"{base}/papers").select("content_hash").distinct().count() == 40 == spark.read.parquet(f"{base}/papers").count()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
