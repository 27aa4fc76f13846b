"""Every registered query with SQL gives the rows of its SQL (on the smallest tables)."""

import math

import duckdb
import pytest

from safesight import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 7) + 0.0 if not math.isnan(v) else None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows(found, columns):
    names = sorted(columns)
    at = [columns.index(c) for c in names]
    return names, sorted(repr([plain(r[i]) for i in at]) for r in found)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    cursor = duck.execute(registry.oracle_sql()[name])
    want = rows(cursor.fetchall(), [d[0] for d in cursor.description])
    assert rows(df.collect(), df.columns) == want


def test_every_query_has_sql():
    assert registry.queries().keys() == registry.oracle_sql().keys()
