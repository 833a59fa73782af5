"""Every registered query of the time-series part against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidalframe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def normal(df):
    cols = sorted(df.columns)
    show = lambda v: "None" if v is None or v != v else (str(v)[:10] if hasattr(v, "year") and str(v)[11:] in ("", "00:00:00") else str(v))
    return cols, sorted(tuple(show(v) for v in row) for row in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, con, name):
    assert normal(catalog.QUERIES[name](spark, SF).toPandas()) == normal(con.sql(catalog.ORACLES[name]).df())


def test_entry_registers_everything(spark):
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
