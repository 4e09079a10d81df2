"""Operator queries against their SQL on a driver table."""

import pytest

from evispark.llm.queries import ORACLES, QUERIES

from ..conftest import SF
from ..oracle import connect, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    df = QUERIES[name](spark, SF)
    names, expected = duck_rows(connect(SF), ORACLES[name])
    assert sorted(df.columns) == names
    assert spark_rows(df) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_a_row_for_each_document(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() == df.select("doc_id").distinct().count() == 200
