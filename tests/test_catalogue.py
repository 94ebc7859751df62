"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from assaygrid import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 5) + 0.0 if isinstance(v, float) else v if isinstance(v, int | str | bool) else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    found = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    ours = sorted(str([plain(r[c]) for c in names]) for r in df.collect())
    assert ours == sorted(str([plain(v) for v in r]) for r in found.fetchall())


@pytest.mark.parametrize("name", ["quota_ranking", "chunk_documents", "clean_sentence_filter", "hausman", "stationarity", "shapiro_wilk", "lasso_path", "domain_labels"])
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
