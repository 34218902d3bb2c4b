"""Every registered query with SQL against DuckDB over the small tables."""

import math

import duckdb
import pytest

from rillweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, list):
        return tuple(map(normal, v))
    if isinstance(v, dict):
        return tuple((k, normal(x)) for k, x in v.items())
    return v


def rows(table):
    names = sorted(table.schema.names)
    return names, sorted(repr([normal(r[n]) for n in names]) for r in table.to_pylist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toArrow()
    assert got.num_rows
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name]).to_arrow_table()
        assert rows(got) == rows(want)
