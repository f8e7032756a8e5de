"""Every query of the reference's operators against its oracle on the smallest tables."""

import duckdb
import pytest

from tessera.plans import registry

TABLES = "events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    return sorted(repr(tuple(r[c] for c in columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, sf, oracle, name):
    got = registry.QUERIES[name](spark, sf)
    wanted = oracle.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    names = list(wanted.columns)
    assert rows_of(columns, got.collect()) == rows_of(columns, [dict(zip(names, r, strict=True)) for r in wanted.fetchall()])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_oracle_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
