"""Every engine query against its DuckDB equivalent."""

import math

import duckdb
import pytest

from rulestrata.plans.registry import QUERIES, SQL

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    ours = sorted(repr([plain(v) for v in r]) for r in df.collect())
    theirs = sorted(repr([plain(r[i]) for i in order]) for r in rel.fetchall())
    assert ours == theirs
