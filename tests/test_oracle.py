"""Every registered query against its DuckDB twin at sf0.01 (what the driver checks)."""

from __future__ import annotations

import pytest

from cargoscope.plans import registry
from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SF01
from tests.oracle_check import digest, duck

# The training-data queries have tests of their own in tests/llm.
QUERIES = {n: f for n, f in queries().items() if n in registry.QUERIES}
SQL = {n: q for n, q in oracle_sql().items() if n in registry.QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "mes"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF01)
    cols = sorted(df.columns)
    srows = [tuple(r[c] for c in cols) for r in df.collect()]
    rel = con.execute(SQL[name])
    dcols = [x[0] for x in rel.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(r[i] for i in idx) for r in rel.fetchall()]
    assert len(srows) == len(drows)
    hs, ls = digest(srows)
    hd, ld = digest(drows)
    assert hs == hd, (sorted(set(ls) - set(ld))[:3], sorted(set(ld) - set(ls))[:3])


def test_checker_detects_a_difference(spark, con):
    """The comparison is not vacuous: page 2 differs from page 3."""
    df = QUERIES["fact_page"](spark, SF01)
    cols = sorted(df.columns)
    srows = [tuple(r[c] for c in cols) for r in df.collect()]
    rel = con.execute(SQL["fact_page"].replace("OFFSET 50", "OFFSET 100"))
    dcols = [x[0] for x in rel.description]
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(r[i] for i in idx) for r in rel.fetchall()]
    assert digest(srows)[0] != digest(drows)[0]


def test_broken_filter_entry_shows(spark, con, monkeypatch):
    """The oracle has its own filter map: a wrong entry on the Spark side makes the results differ."""
    from cargoscope.functions import predicates

    name = "panel_executive_filtered"
    monkeypatch.setitem(predicates.FACT_FILTER_COLUMNS, "tipo_proceso", "aprobacion")
    df = QUERIES[name](spark, SF01)
    rel = con.execute(SQL[name])
    names = [x[0] for x in rel.description]
    (want,) = rel.fetchall()
    (got,) = df.collect()
    assert [got[c] for c in names] != list(want)


def test_every_filter_is_used():
    from cargoscope.functions.predicates import FACT_FILTER_COLUMNS, TRIP_FILTER_COLUMNS

    sets = [registry.FACT_FILTER_ARGS, registry.PANEL_FACT_ARGS, registry.RANKING_ARGS, registry.PENDING_ARGS,
            registry.EXECUTIVE_ARGS, registry.DISPATCH_ARGS]
    assert set(FACT_FILTER_COLUMNS) <= {k for s in sets for k in s}
    trips = [registry.TRIP_FILTER_ARGS, registry.PANEL_TRIP_ARGS, registry.ZONE_ARGS]
    assert set(TRIP_FILTER_COLUMNS) | {"ns"} <= {k for s in trips for k in s}
