"""Every registered query with an SQL twin, on the smallest tables."""

import importlib.util
import os

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

spec = importlib.util.spec_from_file_location("check", f"{ROOT}/tools/check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)
QUERIES, ORACLES = check.contract.queries(), check.contract.oracle_sql()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted([tuple(check.norm(x) for x in r) for r in df.select(*cols).collect()],
                 key=check.key)
    res = con.sql(ORACLES[name])
    order = [res.columns.index(c) for c in cols]
    want = sorted([tuple(check.norm(r[i]) for i in order) for r in res.fetchall()], key=check.key)
    assert got == want
