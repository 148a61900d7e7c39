"""Every query with oracle SQL returns DuckDB's rows; the others return rows of a stable schema."""

from __future__ import annotations

import pytest
from compare import connection, duck_rows, spark_rows

from ethogrid.plans.catalogue import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, sf_dir, name):
    columns, rows = spark_rows(QUERIES[name](spark, sf_dir))
    wanted_columns, wanted = duck_rows(duck, ORACLE[name])
    assert columns == wanted_columns
    assert rows == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0
