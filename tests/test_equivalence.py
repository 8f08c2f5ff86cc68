"""Equivalences: one-scan rewrites equal the reference's N-query forms."""

from __future__ import annotations

from pyspark.sql import functions as F

import pytest

from cargoscope.functions.predicates import not_blank
from cargoscope.functions.scalars import month_key
from cargoscope.operators import facets as FC
from cargoscope.operators import kpis as K
from cargoscope.operators import distributions as D
from cargoscope.plans import dashboard as P
from cargoscope.sources.roles import lazy_role, role
from tests.conftest import SF001


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_status_panel_unpivot_equals_union(spark):
    b = role(spark, SF001, "billing")
    one = FC.status_panel(b).select("grupo", "nombre", "viajes", "total")
    union = FC.status_panel_union(b).select("grupo", "nombre", "viajes", "total")
    assert as_set(one) == as_set(union)
    # the panel keeps '' and drops NULL
    names = {(r["grupo"], r["nombre"]) for r in one.collect()}
    assert ("FLT", "") in names and not any(n is None for _, n in names)


def test_one_scan_facets_equal_one_query_per_column(spark):
    b = role(spark, SF001, "billing")
    got = as_set(P.billing_facets(b))
    want = set()
    for facet, col in FC.FACT_FACETS.items():
        want |= {(facet, r[0]) for r in b.where(not_blank(col)).select(col).distinct().collect()}
    want |= {("meses", r[0]) for r in b.where(F.col("fecha_creacion").isNotNull())
             .select(month_key("fecha_creacion")).distinct().collect()}
    assert got == want


def test_counts_by_state_sum_to_total(spark):
    b = role(spark, SF001, "billing")
    total = K.billing_kpis(b).first()["total_viajes"]
    by_state = D.count_by(b, "estado_contable", "keep").agg(F.sum("cantidad")).first()[0]
    assert by_state == total


def test_materialised_role_equals_lazy_plan(spark):
    for name in ("billing", "trips", "dispatch"):
        a = role(spark, SF001, name)
        b = lazy_role(spark, SF001, name)
        assert a.schema.simpleString() == b.schema.simpleString()
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_home_summary_counts(spark):
    r = K.home_summary(role(spark, SF001, "orders"), role(spark, SF001, "billing"), role(spark, SF001, "dispatch"),
                       role(spark, SF001, "on_time"), role(spark, SF001, "trips")).first()
    assert r["total_oc"] == role(spark, SF001, "orders").count()
    assert r["total_fletes"] == r["total_despachos"] == r["total_viajes_pend"] == role(spark, SF001, "billing").count()


def test_panel_split_by_group(spark):
    panel = FC.status_panel(role(spark, SF001, "billing"))
    parts = [FC.panel_group(panel, g).count() for g in FC.STATUS_GROUPS]
    assert sum(parts) == panel.count() and all(n > 0 for n in parts)


def test_role_table_is_reused_and_refresh_writes_a_newer_attempt(spark):
    from cargoscope.sources import roles as RL
    first = RL.role(spark, SF001, "dispatch").inputFiles()[0]
    RL._MEMO.clear()
    again = RL.role(spark, SF001, "dispatch").inputFiles()[0]
    folder = lambda f: f.rsplit("/", 1)[0]  # noqa: E731 - the attempt folder holding the file
    assert folder(first) == folder(again)                    # same attempt folder, no rewrite
    newer = RL.role(spark, SF001, "dispatch", refresh=True).inputFiles()[0]
    assert folder(newer) > folder(first)                     # a later attempt is now read


def test_operations_panels_equal_the_separate_panels(spark):
    b = role(spark, SF001, "billing")
    tab = FC.category_panels(b)
    panel = FC.status_panel(b)
    for g in FC.STATUS_GROUPS:
        assert as_set(FC.panel_group(tab, g)) == as_set(FC.panel_group(panel, g))
    for g, (col, blanks) in FC.OPERATIONS_PANELS.items():
        if g in FC.STATUS_GROUPS:
            continue
        want = {("x", *r) for r in D.amount_by(b, col, blanks).collect()}
        got = {("x", *r[1:]) for r in FC.panel_group(tab, g).collect()}
        assert got == want, g


def test_trip_panels_equal_the_separate_panels(spark):
    from cargoscope.operators.buckets import delay_buckets
    t = role(spark, SF001, "trips")
    tab = FC.trip_panels(t)
    zone = {(r["nombre"], r["cantidad"]) for r in FC.panel_group(tab, "zona").collect()}
    assert zone == {(r["zona"], r["cantidad"]) for r in D.count_by(t, "zona", "drop_blank").collect()}
    dept = {(r["nombre"], r["cantidad"], r["cumpl"]) for r in FC.panel_group(tab, "departamento").collect()}
    want = D.compliance_by(t, "departamento", "drop_blank", "cumpl").collect()
    assert dept == {(r["departamento"], r["cantidad"], r["cumpl"]) for r in want}
    buckets = FC.panel_group(tab, "rango").orderBy("orden").collect()
    assert [(r["nombre"], r["cantidad"]) for r in buckets] == [tuple(r) for r in delay_buckets(t).collect()]


def test_commercial_tab_equals_the_separate_panels(spark):
    from cargoscope.functions.scalars import to_edge
    from cargoscope.operators import rollups as R
    from cargoscope.operators import scorecards as S
    from cargoscope.plans import dashboard as P
    b = role(spark, SF001, "billing")
    tab = P.commercial_tab(b)

    def same(got, want):
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        g = {tuple(r[c] for c in cols) for r in to_edge(got).collect()}
        w = {tuple(r[c] for c in cols) for r in to_edge(want).collect()}
        assert g == w

    same(tab["resumen"], K.executive_summary(b))
    trend = R.monthly_trend(b)
    same(tab["mes"], trend.select(*tab["mes"].columns))
    ranking = S.company_ranking(b)
    same(tab["compania"], ranking.select(*tab["compania"].columns))
    same(tab["status_cont_aje"], D.amount_by(b, "status_contabilidad_aje", "drop_blank"))


def test_tab_splitters(spark):
    from cargoscope.plans import dashboard as P
    ops = P.operations_tab(role(spark, SF001, "billing"), mes_desde="1997-01")
    assert set(ops) == set(FC.OPERATIONS_PANELS)
    assert as_set(ops["tipo_fact"]) == as_set(
        D.amount_by(role(spark, SF001, "billing").where(F.col("fecha_creacion") >= "1997-01-01"), "tipo_fact",
                    "drop_blank"))
    trips = P.trips_tab(role(spark, SF001, "trips"), zona="ASIA")
    assert set(trips) == {"zona", "departamento", "rango"}
    assert [r["zona"] for r in trips["zona"].collect()] == ["ASIA"]


def test_building_a_share_writes_no_file(spark):
    import glob
    from cargoscope.plans import dashboard as P
    from cargoscope.session import checkpoint_dir
    b = role(spark, SF001, "billing")
    here = checkpoint_dir(spark).removeprefix("file:")
    before = len(glob.glob(f"{here}/**", recursive=True))
    panels = P.status_panel(b), P.company_ranking(b), P.billing_share(b, "aprobacion")
    assert all(p.columns for p in panels) and len(glob.glob(f"{here}/**", recursive=True)) == before


def test_unwritable_checkpoint_folder_is_an_error(spark, monkeypatch):
    from cargoscope.sources import roles as RL
    monkeypatch.setattr(RL, "checkpoint_dir", lambda _spark: "/proc/cargoscope-cannot-write-here")
    with pytest.raises(Exception):
        RL.role(spark, SF001, "dispatch", refresh=True)
    monkeypatch.setattr(RL, "checkpoint_dir", lambda _spark: None)
    with pytest.raises(ValueError):
        RL.role(spark, SF001, "dispatch")
    assert RL.role(spark, SF001, "dispatch", written=False).count() == RL.lazy_role(spark, SF001, "dispatch").count()


def test_added_rows_reach_the_next_call(spark, tmp_path):
    from cargoscope.sources import roles as RL
    from cargoscope.sources.tables import TABLE_NAMES, table
    for n in TABLE_NAMES:
        table(spark, SF001, n).write.parquet(f"{tmp_path}/{n}.parquet")
    d = str(tmp_path)
    before = RL.role(spark, d, "dispatch").count()
    table(spark, SF001, "lineitem").write.mode("append").parquet(f"{d}/lineitem.parquet")
    assert RL.role(spark, d, "dispatch").count() == before           # the pinned snapshot
    RL.refresh(spark, d)
    assert RL.role(spark, d, "dispatch").count() == 2 * before
