"""Every registered query with SQL, against the same SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from workload.registry import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return c


def _cell(x):
    return "<null>" if x is None else str(int(x)) if isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(tuple(_cell(r[i]) for i in at) for r in result.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
