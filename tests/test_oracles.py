"""Every query with SQL gives what DuckDB gives on the same tables."""

import pytest

from graphloom.plans import explain, general, graph, ingest, reports
from tests.helpers import connect, rows

PAIRS = [(k, m.QUERIES[k], m.ORACLE[k]) for m in (general, graph, ingest, reports, explain) for k in m.QUERIES if k in m.ORACLE]


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name,query,sql", PAIRS, ids=[p[0] for p in PAIRS])
def test_same_as_sql(spark, sf, duck, name, query, sql):
    ours, theirs = query(spark, sf).toPandas(), duck.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", [k for m in (general, graph, ingest, reports, explain) for k in m.QUERIES if k not in m.ORACLE])
def test_runs_without_sql(spark, sf, name):
    f = next(m.QUERIES[name] for m in (general, graph, ingest, reports, explain) if name in m.QUERIES)
    assert f(spark, sf).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["node_id", "root_id", "depth"]
    assert set(e.oracle_sql()) <= set(e.queries())
