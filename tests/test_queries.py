"""Every registered query against its SQL twin, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

import kgspark.registry as registry

registry.load()


@pytest.fixture(scope="session")
def duck(sf):
    own = duckdb.connect()
    own.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf):
        own.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return own


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda x: f"{float(x):.9g}" if isinstance(x, (float, decimal.Decimal)) else str(int(x)) if isinstance(x, bool) else str(x)
    return sorted(tuple(cell(float(r[i]) if isinstance(r[i], int) and not isinstance(r[i], bool) else r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf, name):
    found = registry.QUERIES[name](spark, sf)
    own = rows(found.columns, [tuple(r) for r in found.collect()])
    if name in registry.ORACLE:
        twin = duck.sql(registry.ORACLE[name])
        assert sorted(found.columns) == sorted(twin.columns)
        assert own == rows(twin.columns, twin.fetchall())


@pytest.mark.parametrize("name", ["sm07_sample", "sm09_sample_pairs", "sm10_sample_boolean", "gq24_limit", "rt06_capped"])
def test_limited_queries_repeat(spark, sf, name):
    assert sorted(map(str, registry.QUERIES[name](spark, sf).collect())) == sorted(map(str, registry.QUERIES[name](spark, sf).collect()))
