"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(rows):
    def value(v):
        if v is None or (not isinstance(v, str | bytes | list) and pd.isna(v)):
            return None
        return round(float(v), 9) if isinstance(v, int | float) or hasattr(v, "dtype") else str(v)

    return sorted(str([value(v) for v in r]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    df = entry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(entry.ORACLES[name]).fetchdf()
    assert sorted(want.columns) == columns
    got = df.select(*columns).toPandas()
    assert plain(got.astype(object).itertuples(index=False, name=None)) == plain(want[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(set(entry.QUERIES) - set(entry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert entry.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "doc_id", "score"] and df.count() > 0
