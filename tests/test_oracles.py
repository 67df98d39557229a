"""Every query with SQL gives what DuckDB gives, on the smallest driver tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from lodestar import queries as module

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not there")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(module.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = module.queries()[name](spark, DATA).toPandas()
    want = duck.sql(module.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        assert (got[c] == want[c]).all(), c
        assert got[c].dtype == want[c].dtype, c


def test_names_without_sql_are_the_iterative_ones():
    rest = set(module.queries()) - set(module.oracle_sql())
    assert rest == {"partition_plan", "nn_descent_graph", "index_search_recall", "connect_repair"}
