"""Every registered query: name -> (spark, sf_dir) -> DataFrame in edge form.

Each query reads the driver's tables through the role frames (sources/roles.py)
and runs over the whole tables; the only limits are the ones that are the
feature (top-k lists, a page, the first-3-months smoke query).
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from cargoscope.functions.predicates import trip_filter
from cargoscope.functions.scalars import to_edge
from cargoscope.operators import distributions as D
from cargoscope.operators import facets as FC
from cargoscope.operators import kpis as K
from cargoscope.operators import rollups as R
from cargoscope.operators import scorecards as S
from cargoscope.operators import topk as TK
from cargoscope.operators.detail import (export_rows, fact_detail, fact_page, fact_page_after, fact_pages, view_detail,
                                         with_destination, with_fact_labels, with_trip_labels)
from cargoscope.operators.paging import Cursor
from cargoscope.plans import dashboard as P
from cargoscope.plans.saved import SavedViews, folder_of
from cargoscope.plans.views import VIEWS
from cargoscope.session import checkpoint_dir, ensure_checkpoint_dir
from cargoscope.sources.metadata import metadata_session
from cargoscope.sources.roles import month_directory, role, roles, snapshot

# Fixed parameters of the registered filter queries and the due-soon reference date.
AS_OF = "1998-06-30"
TRIP_FILTER_ARGS = {"planta": "NATION_3", "zona": "AMERICA", "ns": "OFF_TIME"}
FACT_FILTER_ARGS = {"estado_contable": "Facturado", "aprobacion": "BUILDING"}
MONTH_RANGE_ARGS = {"mes_desde": "1996-03", "mes_hasta": "1997-02"}
FACT_PAGE = (2, 50)
FACT_AFTER = "1996-05-01 00:00:00"
FACT_DEEP_PAGE = (400, 50)
FACT_STEPS = (6, 50)
SHARE_PANELS = {"share_collection": "status_crisar", "share_bill_type": "tipo_fact", "share_approval": "aprobacion",
                "share_ledger": "status_contabilidad_aje"}
SAVED = {"monthly": "v_fact_mensual", "company": "v_fact_compania", "carrier": "v_fact_transportista",
         "collection": "v_status_crisar", "dispatch": "v_envio_factura", "pending_top": "v_pendientes_top",
         "detail": "v_fletes_detalle", "on_time": "v_on_time_resumen"}
# Dashboard panels with their filters applied (filter composition checked end to end).
PANEL_FACT_ARGS = {"compania": "NATION_7", "estado_flt": "Con FLT", "mes_desde": "1997-01", "mes_hasta": "1999-12"}
PANEL_TRIP_ARGS = {"planta": "NATION_12", "zona": "ASIA"}
# Filtered panels that use the filters which the ones above leave out.
RANKING_ARGS = {"estado_flete": "CONFIRMADO", "status_crisar": "COBRADO"}
PENDING_ARGS = {"estado_conciliacion": "CONCILIADO", "estado_envio_factura": "ACEPTADO"}
EXECUTIVE_ARGS = {"status_cont_aje": "RF", "tipo_proceso": "Brand#4"}
DISPATCH_ARGS = {"tipo_fact": "MEDIUM", "mes_desde": "1995-12"}
ZONE_ARGS = {"destino": "NATION_5", "ns": "ON_TIME"}

Query = Callable[[SparkSession, str], DataFrame]


def _on(role_name: str, op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: op(role(spark, sf, role_name))


def _billing_dist(dim: str) -> Query:
    return _on("billing", lambda b: D.amount_by(b, dim, "drop_blank"))


def _freight_dist(dim: str, blanks: str, with_avg: bool = False) -> Query:
    return _on("freight", lambda f: D.amount_by(f, dim, blanks, with_avg=with_avg))


def _overview(panel: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf: panel(roles(spark, sf), *args)


def _from_metadata(panel: Callable[..., DataFrame]) -> Query:
    """A panel whose counts come from file metadata."""
    return lambda spark, sf: panel(roles(metadata_session(spark), sf))


def _pages(op: Callable[..., DataFrame]) -> Query:
    """A page of the billing table, found by the snapshot's directory of rows per month."""
    return lambda spark, sf: op(role(spark, sf, "billing"), month_directory(spark, sf))


def _saved(read: Callable[[SavedViews], DataFrame]) -> Query:
    """A read of the saved views, brought up to the snapshot once and pinned with it."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        views = SavedViews(spark, folder_of(spark, sf))
        views.record = snapshot(spark, sf).note(("saved", views.base), lambda: views.refresh(sf).record)
        return read(views)

    return query


QUERIES: dict[str, Query] = {
    # sources / catalog
    "preview": _overview(P.table_preview, "trips", 100, True),
    "table_counts": _from_metadata(P.table_info),
    # filters
    "trips_filtered": _on("trips", lambda t: t.where(trip_filter(**TRIP_FILTER_ARGS)).select(
        "referencia", "origen_carga", "destino_carga", "zona", "NS", "dias_retrazo")),
    "fact_filtered": _on("billing", lambda b: fact_detail(b.where(P.fact_where(b, **FACT_FILTER_ARGS)))),
    "fact_month_range": _on("billing", lambda b: R.monthly_trend(b, where=P.fact_where(b, **MONTH_RANGE_ARGS))),
    "panel_kpi_filtered": _on("billing", lambda b: P.billing_kpi(b, **PANEL_FACT_ARGS)),
    "panel_status_filtered": _on("billing", lambda b: P.status_panel(b, **PANEL_FACT_ARGS)),
    "panel_table_filtered": _on("billing", lambda b: P.billing_table(b, 3, 20, **PANEL_FACT_ARGS)),
    "panel_trips_filtered": _on("trips", lambda t: P.trip_summary(t, **PANEL_TRIP_ARGS)),
    "panel_delays_filtered": _on("trips", lambda t: P.trip_delays(t, **PANEL_TRIP_ARGS)),
    "panel_ranking_filtered": _on("billing", lambda b: P.company_ranking(b, **RANKING_ARGS)),
    "panel_pending_filtered": _on("billing", lambda b: P.pending_top(b, **PENDING_ARGS)),
    "panel_executive_filtered": _on("billing", lambda b: P.executive_summary(b, **EXECUTIVE_ARGS)),
    "panel_dispatch_filtered": _on("billing", lambda b: P.billing_distribution(
        b, "estado_envio_factura", **DISPATCH_ARGS)),
    "panel_zones_filtered": _on("trips", lambda t: P.trip_zones(t, **ZONE_ARGS)),
    # KPI rows
    "home_summary": _from_metadata(P.overview_summary),
    "trip_kpis": _on("trips", P.trip_summary),
    "billing_kpis": _on("billing", K.billing_kpis),
    "executive_summary": _on("billing", K.executive_summary),
    "freight_kpis": _on("freight", K.freight_kpis),
    "validation_kpis": _on("validated", K.validation_kpis),
    "date_ranges": _on("freight", K.date_ranges),
    # monthly rollups
    "monthly_freight": _overview(P.monthly_freight),
    "on_time_trend": _overview(P.on_time_trend),
    "monthly_trend": _on("billing", R.monthly_trend),
    "view_monthly": _on("validated", R.view_monthly),
    "view_on_time": _on("validated", R.view_on_time),
    "monthly_billing": _on("billing", R.monthly_billing),
    "monthly_pct_billed": _on("billing", R.monthly_pct_billed),
    "monthly_fare": _on("freight", R.monthly_fare),
    "monthly_first3": _on("freight", lambda f: R.monthly_first(f, 3)),
    # distributions
    "dist_order_state": _overview(P.order_states),
    "dist_plant": _overview(P.plant_dispatches),
    "dist_reconciliation": _overview(P.reconciliation),
    "zone_compliance": _overview(P.pending_trips_by_zone),
    "dist_zone": _on("trips", P.trip_zones),
    "dist_department": _on("trips", lambda t: D.compliance_by(t, "departamento", "drop_blank", "cumpl")),
    "dist_collection": _billing_dist("status_crisar"),
    "dist_dispatch": _billing_dist("estado_envio_factura"),
    "dist_bill_type": _billing_dist("tipo_fact"),
    "dist_ledger": _billing_dist("status_contabilidad_aje"),
    "dist_approval": _billing_dist("aprobacion"),
    "dist_process": _billing_dist("tipo_proceso"),
    "dist_carrier": _freight_dist("transportista", "drop_blank", with_avg=True),
    "dist_company": _freight_dist("nombre_compania", "drop_null"),
    "dist_accounting": _freight_dist("estado_contable", "drop_null"),
    "dist_reconciliation_value": _freight_dist("estado_conciliacion", "drop_null"),
    "dist_transport": _freight_dist("tipo_transporte", "drop_blank", with_avg=True),
    "dist_freight_state": _freight_dist("estado_flete", "drop_null"),
    "dist_how_billed": _freight_dist("como_factura", "drop_null"),
    "dist_reason": _on("validated", lambda v: D.amount_by(v, "motivo", "drop_blank")),
    "dist_filter": _on("validated", lambda v: D.amount_by(v, "Filtro", "drop_blank")),
    "dist_note": _on("validated", lambda v: D.amount_by(v, "observacion", "drop_blank")),
    "view_collection": _on("validated", VIEWS["v_status_crisar"]),
    "view_dispatch": _on("validated", VIEWS["v_envio_factura"]),
    # scorecards
    "company_ranking": _on("billing", S.company_ranking),
    "view_company": _on("validated", S.view_company),
    "view_carrier": _on("validated", S.view_carrier),
    "company_billing": _on("billing", S.company_billing),
    # buckets, facets, status panel
    "delay_buckets": _on("trips", P.trip_delays),
    "trip_facets": _on("trips", P.trip_facets),
    "trip_facets_extended": _on("trips", lambda t: FC.facets(t, FC.TRIP_FACETS_EXTENDED)),
    "fact_facets": _on("billing", P.billing_facets),
    "freight_facets": _on("freight", lambda f: FC.facets(
        f, {c: c for c in FC.FREIGHT_FACET_COLUMNS}, month_facets={"mes": "fecha"})),
    "freight_facet_counts": _on("freight", lambda f: FC.facet_counts(FC.facets(
        f, {c: c for c in FC.FREIGHT_FACET_COLUMNS}, month_facets={"mes": "fecha"}))),
    "status_panel": _on("billing", FC.status_panel),
    "status_panel_union": _on("billing", FC.status_panel_union),
    "status_panel_flt": _on("billing", lambda b: FC.panel_group(FC.status_panel(b), "FLT")),
    "operations_panels": _on("billing", P.operations_panels),
    "trip_panels": _on("trips", P.trip_category_panels),
    "commercial_panels": _on("billing", P.commercial_panels),
    # windows over aggregates, derived measures
    "share_of_total": _on("billing", P.status_panel),
    "share_of_max": _on("billing", P.dispatch_panel),
    "latest_month": _pages(P.billing_latest_month),
    "billing_kpis_derived": _on("billing", P.billing_kpi),
    "company_stack": _on("billing", P.company_ranking),
    "receivables": _on("billing", P.executive_summary),
    "dept_band": _on("trips", P.trip_departments),
    "pending_top_bars": _on("billing", P.pending_top),
    # top-k, detail, paging, export
    "top_companies": _overview(P.top_carriers),
    "pending_top": _on("billing", TK.pending_top),
    "view_pending_top": _on("validated", TK.view_pending_top),
    "pending_top_carrier": _on("billing", TK.pending_top_carrier),
    "pending_top_bounded": _on("billing", TK.pending_top_bounded),
    "top_branches": _on("freight", TK.top_branches),
    "trips_due_soon": _on("trips", lambda t: P.trip_upcoming(t, AS_OF)),
    "trip_table": _on("trips", P.trip_table),
    "fact_page": _pages(lambda b, d: fact_page(b, *FACT_PAGE, directory=d)),
    "fact_page_after": _pages(lambda b, d: fact_page_after(
        b, Cursor({"fecha_creacion": datetime.fromisoformat(FACT_AFTER)}, 0), directory=d)),
    "fact_pages_stepped": _pages(lambda b, d: fact_pages(b, *FACT_STEPS, directory=d)),
    "fact_page_deep": _pages(lambda b, d: fact_page(b, *FACT_DEEP_PAGE, directory=d)),
    **{name: _on("billing", lambda b, _d=dim: P.billing_share(b, _d)) for name, dim in SHARE_PANELS.items()},
    "fact_tags": _pages(lambda b, d: P.billing_table(b, 1, 50, directory=d)),
    "fact_labels": _pages(lambda b, d: with_fact_labels(fact_page(b, 1, 50, directory=d))),
    "trip_table_labels": _on("trips", lambda t: with_trip_labels(P.trip_table(t))),
    "trips_due_soon_labels": _on("trips", lambda t: with_destination(P.trip_upcoming(t, AS_OF))),
    "export_detail": _on("billing", export_rows),
    "view_detail": _on("validated", view_detail),
    # saved views and KPI rows from stored partials
    **{f"saved_{key}": _saved(lambda s, _n=name: s.view(_n)) for key, name in SAVED.items()},
    "saved_kpis": _saved(lambda s: s.kpis()),
    "saved_kpis_range": _saved(lambda s: s.kpis(**MONTH_RANGE_ARGS)),
}


def run(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    """The named query in edge form (money as DOUBLE, datetimes as ISO text).

    A query asks only for the roles it uses. A local session without a checkpoint
    folder (tests) gets a temporary one; a cluster must name a shared folder.
    """
    if checkpoint_dir(spark) is None and spark.sparkContext.master.startswith("local["):
        ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="cargoscope-ckpt-"))
    return to_edge(QUERIES[name](spark, sf_dir))
