"""Every query with SQL gives the same rows in Spark and DuckDB."""

import pytest

from evispark.queries import ORACLES, QUERIES

from .conftest import SF
from .oracle import connect, duck_rows, spark_rows


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    names, expected = duck_rows(con, ORACLES[name])
    assert sorted(df.columns) == names
    assert spark_rows(df) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_masked_values_that_tie(spark, tmp_path):
    """Balances whose thousandths are a tie as text but not as a product of doubles, and the other way round."""
    balances = [-505.5, 8150.5, -507.5, 0.5, 1.5, -0.5, -0.4, 1234.49, None]
    rows = [(i, f"C{i}", i % 25, "BUILDING", b) for i, b in enumerate(balances)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = connect(tmp_path, [])
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    _, expected = duck_rows(con, ORACLES["mask_by_role"])
    assert spark_rows(QUERIES["mask_by_role"](spark, str(tmp_path))) == expected
