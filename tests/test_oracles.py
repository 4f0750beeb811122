"""Every query of the library that SQL can express, against DuckDB on the smallest tables."""

import os
import re

import duckdb
import pytest

from gatescan.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("customer", "events", "lineitem", "orders"):
        c.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


def _rows(table):
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r.values()) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(ORACLES[name]).select(*[f'"{x}"' for x in columns]).to_arrow_table()
    assert sorted(con.sql(ORACLES[name]).columns) == columns
    assert _rows(got.select(*columns).toArrow()) == _rows(want)


def test_every_query_has_an_oracle_and_a_documented_id():
    assert set(QUERIES) == set(ORACLES)
    assert all(re.match(r"[afjrstw]\d+_", n) for n in QUERIES)
