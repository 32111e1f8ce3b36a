"""Every query with an oracle gives DuckDB's rows, value for value."""

import math
import os

import duckdb
import pytest

from panelia.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return connection


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return float(v) if isinstance(v, (int, float)) else str(v)

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_and_contract(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
