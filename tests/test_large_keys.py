"""Queries agree with their SQL on keys far beyond those of the small tables."""

import duckdb
import pytest

from dipscan.plans import registry

from test_oracle import plain

SOURCE = "/root/testdata/sf0.001"


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for file in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = registry.queries()[name](spark, str(folder))
    mine = sorted((tuple(plain(v) for v in row) for row in df.collect()), key=repr)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    result = con.execute(f"SELECT {columns} FROM ({registry.oracle_sql()[name]})")
    assert mine and mine == sorted((tuple(plain(v) for v in row) for row in result.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["difference_images", "pixel_noise_scale"])
def test_late_epochs(spark, tmp_path, name):
    """Dips beyond number 2000 are in the SQL too."""
    duckdb.sql(f"""COPY (SELECT * REPLACE (vec_id + 100000 AS vec_id) FROM '{SOURCE}/embeddings.parquet')
      TO '{tmp_path}/embeddings.parquet'""")
    same_as_sql(spark, tmp_path, name)


def test_order_keys_that_look_like_julian_dates(spark, tmp_path):
    duckdb.sql(f"""COPY (SELECT * REPLACE (o_orderkey + 1999500 AS o_orderkey) FROM '{SOURCE}/orders.parquet')
      TO '{tmp_path}/orders.parquet'""")
    same_as_sql(spark, tmp_path, "cell_coercion")
