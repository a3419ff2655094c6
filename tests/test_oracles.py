"""Every core query against its SQL counterpart on the smallest tables."""

import pytest

from compare import canon, connect, rows_of
from tessera import queries as core

QUERIES, ORACLES = core.queries(), core.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    want = duck.execute(ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns and df.limit(5).collect() is not None


def test_every_query_is_described():
    assert all(f.__doc__ for f in QUERIES.values())
    assert set(ORACLES) <= set(QUERIES)


def test_canon_tells_apart():
    assert canon(1.0000000001) == canon(1.0) and canon(1.00001) != canon(1.0)
