"""Every library query against its SQL in DuckDB over the smallest tables, and the same rows under another partitioning."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from codefacts import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        parts = glob.glob(f"{SF}/{t}.parquet/*.parquet") or [f"{SF}/{t}.parquet"]
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({parts})")
    return con


def plain(value):
    """Numbers alike, whatever type nulls have turned a column into."""
    if value is None or value != value:
        return ""
    if isinstance(value, str):
        return value
    return f"{float(value):.6f}".rstrip("0").rstrip(".") if hasattr(value, "__float__") else str(value)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple("" if pd.isna(v) else plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = rows(catalog.QUERIES[name](spark, SF).toPandas())
    assert got[1], "no rows"
    if name in catalog.ORACLE_SQL:
        assert got == rows(duck.execute(catalog.ORACLE_SQL[name]).fetchdf())


@pytest.mark.parametrize("name", ["transitive_dependencies", "resolve_calls", "search_symbols", "attach_macro_symbol"])
def test_rows_do_not_depend_on_partitions(spark, name):
    before = rows(catalog.QUERIES[name](spark, SF).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
