"""The driver contract, and every oracle query against DuckDB on sf0.001."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from panelkit.session import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_contract_keys():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 61


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "completeness" in df.columns


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


FAST_ORACLE = [k for k in entry.oracle_sql()]


@pytest.mark.parametrize("name", FAST_ORACLE)
def test_oracle_match(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cols = df.columns
    a = sorted("|".join(_norm(r[c]) for c in sorted(cols)) for r in df.collect())
    rel = con.sql(entry.oracle_sql()[name])
    dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    tmap = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
    assert {c: tmap.get(t, t) for c, t in df.dtypes} == dtypes
    cur = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == sorted(cols)
    order = sorted(range(len(dcols)), key=lambda i: dcols[i])
    b = sorted("|".join(_norm(r[i]) for i in order) for r in cur.fetchall())
    assert a == b
