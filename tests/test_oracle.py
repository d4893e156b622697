"""Every query with SQL agrees with an independent engine on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from dipscan.plans import registry

FOLDER = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}") + 0.0
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return float(value) if hasattr(value, "as_tuple") else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr)
    result = con.execute(SQL[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    other = sorted((tuple(plain(row[i]) for i in at) for row in result.fetchall()), key=repr)
    assert mine == other
