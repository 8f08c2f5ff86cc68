"""The dashboard panels: each is a filter (FLT-1 or FLT-3/4) composed with an operator.

Filters are Columns, so the whole panel is one logical plan: Catalyst pushes
the equality and month-range predicates into the Parquet scan and prunes the
scan to the panel's columns.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.functions.predicates import fact_filter, trip_filter
from cargoscope.operators import distributions as D
from cargoscope.operators import facets as FC
from cargoscope.operators import kpis as K
from cargoscope.operators import rollups as R
from cargoscope.operators import scorecards as S
from cargoscope.operators import shares as SH
from cargoscope.operators import topk as TK
from cargoscope.operators.buckets import delay_buckets
from cargoscope.operators.detail import fact_page, with_dispatch_tag, with_fact_tags
from cargoscope.sources.catalog import ALLOWED_TABLES, preview, table_counts
from cargoscope.sources.roles import BILLING_MONTH_PARTITION

# --- billing dashboard -------------------------------------------------------------


def fact_where(billing: DataFrame, **filters: str) -> Column:
    """FLT-3/4 for this frame: adds the month-folder predicate when the table is partitioned by month."""
    month_col = BILLING_MONTH_PARTITION if BILLING_MONTH_PARTITION in billing.columns else None
    return fact_filter(month_col=month_col, **filters)


def billing_facets(billing: DataFrame) -> DataFrame:
    """FCT-2: all eleven drop-downs plus the months, from one scan."""
    return FC.facets(billing, FC.FACT_FACETS, month_facets={"meses": "fecha_creacion"})


def billing_kpi(billing: DataFrame, **filters: str) -> DataFrame:
    """FLT-3/4 + AGG-3 + DRV-1."""
    return SH.billing_kpis_derived(K.billing_kpis(billing.where(fact_where(billing, **filters))))


def billing_trend(billing: DataFrame, **filters: str) -> DataFrame:
    """FLT-3/4 + AGG-10."""
    return R.monthly_trend(billing, where=fact_where(billing, **filters))


def billing_latest_month(billing: DataFrame, directory=None, **filters: str) -> DataFrame:
    """AGG-10 + WIN-3 + DRV-4 (``directory``: ``detail.month_directory`` of the filtered rows, if it is known; then
    only the latest month's folder is read)."""
    latest = next((month for month, _ in directory or () if month is not None), None)
    if latest is not None:
        billing = billing.where(F.col(BILLING_MONTH_PARTITION) == latest)
    return SH.latest_month(billing_trend(billing, **filters))


def company_ranking(billing: DataFrame, **filters: str) -> DataFrame:
    """FLT-3/4 + AGG-39 + DRV-2 + WIN-1."""
    return SH.company_stack(S.company_ranking(billing, where=fact_where(billing, **filters)))


def billing_distribution(billing: DataFrame, dim: str, **filters: str) -> DataFrame:
    """FLT-3/4 + AGG-23..28: trips and amount per non-blank value of ``dim``."""
    return D.amount_by(billing, dim, "drop_blank", where=fact_where(billing, **filters))


def dispatch_panel(billing: DataFrame, **filters: str) -> DataFrame:
    """AGG-24 + WIN-2 + DRV-7."""
    dist = billing_distribution(billing, "estado_envio_factura", **filters)
    return with_dispatch_tag(SH.share_of_max(dist, "total", "barra_pct"))


def billing_share(billing: DataFrame, dim: str, **filters: str) -> DataFrame:
    """FLT-3/4 + AGG-23..28 + WIN-1: ``billing_distribution`` with each value's share of all."""
    return SH.share_of_total(billing_distribution(billing, dim, **filters), "total", "pct_total")


def status_panel(billing: DataFrame, **filters: str) -> DataFrame:
    """SET-1 + WIN-1: the four status groups with each state's share of its group."""
    panel = FC.status_panel_rows(billing, where=fact_where(billing, **filters))
    return FC.panel_order(SH.share_of_total(panel, "total", "pct_grupo", partition_by=["grupo"]))


def operations_panels(billing: DataFrame, **filters: str) -> DataFrame:
    """The operations tab's eight category panels (status groups and distributions) in one scan."""
    return FC.category_panels(billing, where=fact_where(billing, **filters))


def commercial_panels(billing: DataFrame, **filters: str) -> DataFrame:
    """The commercial tab's summary, monthly trend, company ranking and ledger panel in one scan (long form)."""
    return K.commercial_panels(billing, where=fact_where(billing, **filters))


def split_panels(long: DataFrame, renames: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    """Split a long-form tab result into its panels.

    Lazy: each panel is a filter of the long result. A caller that reads several
    panels of one load writes ``long`` once (or persists it) and passes that.
    ``renames[grupo]`` maps long-form column names to the panel's own (the panel
    keeps exactly those columns); an empty mapping keeps every measure column.
    """
    out = {}
    for g, mapping in renames.items():
        part = FC.panel_group(long, g)
        out[g] = (part.select(*[F.col(src).alias(dst) for src, dst in mapping.items()]) if mapping
                  else part.drop("grupo", "clave"))
    return out


def operations_tab(billing: DataFrame, **filters: str) -> dict[str, DataFrame]:
    """The operations tab's eight category panels from one scan (status groups keep their group tag)."""
    renames = {g: ({"grupo": "grupo", "nombre": "nombre", "viajes": "viajes", "total": "total"}
                   if g in FC.STATUS_GROUPS else {"nombre": col, "viajes": "viajes", "total": "total"})
               for g, (col, _) in FC.OPERATIONS_PANELS.items()}
    return split_panels(operations_panels(billing, **filters), renames)


def commercial_tab(billing: DataFrame, **filters: str) -> dict[str, DataFrame]:
    """The four commercial panels, computed by one scan and split from one checkpointed result."""
    return split_panels(commercial_panels(billing, **filters), K.COMMERCIAL_PANELS)


def pending_top(billing: DataFrame, **filters: str) -> DataFrame:
    """TOP-2 + WIN-2."""
    return SH.share_of_max(TK.pending_top(billing, where=fact_where(billing, **filters)), "total", "barra_pct")


def executive_summary(billing: DataFrame, **filters: str) -> DataFrame:
    """AGG-4 + DRV-3."""
    return SH.receivables(K.executive_summary(billing.where(fact_where(billing, **filters))))


def billing_table(billing: DataFrame, page_no: int = 1, size: int = 50, directory=None, **filters: str) -> DataFrame:
    """PAG-1 + DRV-6 (``directory``: ``detail.month_directory`` of the filtered rows, if it is known)."""
    where = fact_where(billing, **filters) if any(filters.values()) else None
    return with_fact_tags(fact_page(billing, page_no, size, where, directory))


# --- trips dashboard ---------------------------------------------------------------


def trip_facets(trips: DataFrame) -> DataFrame:
    """FCT-1."""
    return FC.facets(trips, FC.TRIP_FACETS)


def trip_summary(trips: DataFrame, **filters: str) -> DataFrame:
    """FLT-1 + AGG-2."""
    return K.trip_kpis(trips.where(trip_filter(**filters)))


def trip_zones(trips: DataFrame, **filters: str) -> DataFrame:
    """FLT-1 + AGG-21."""
    return D.count_by(trips, "zona", "drop_blank", where=trip_filter(**filters))


def trip_departments(trips: DataFrame, **filters: str) -> DataFrame:
    """FLT-1 + AGG-22 + DRV-5 + WIN-2."""
    depts = D.compliance_by(trips, "departamento", "drop_blank", "cumpl", where=trip_filter(**filters))
    return SH.with_compliance_band(depts)


def trip_delays(trips: DataFrame, **filters: str) -> DataFrame:
    """FLT-1 + BKT-1."""
    return delay_buckets(trips, where=trip_filter(**filters))


def trip_category_panels(trips: DataFrame, **filters: str) -> DataFrame:
    """AGG-21 + AGG-22 + BKT-1 in one scan (long form; split with ``facets.panel_group``)."""
    return FC.trip_panels(trips, where=trip_filter(**filters))


def trips_tab(trips: DataFrame, **filters: str) -> dict[str, DataFrame]:
    """The zone, department and delay-bucket panels from one scan."""
    renames = {"zona": {"nombre": "zona", "cantidad": "cantidad"},
               "departamento": {"nombre": "departamento", "cantidad": "cantidad", "cumpl": "cumpl"},
               "rango": {"nombre": "rango", "cantidad": "cantidad", "orden": "orden"}}
    return split_panels(trip_category_panels(trips, **filters), renames)


def trip_upcoming(trips: DataFrame, as_of: str | None = None, **filters: str) -> DataFrame:
    """FLT-1 + FLT-10 + TOP-6 (``as_of`` defaults to today)."""
    return TK.trips_due_soon(trips, as_of, where=trip_filter(**filters))


def trip_table(trips: DataFrame, **filters: str) -> DataFrame:
    """FLT-1 + TOP-7."""
    return TK.trip_table(trips, where=trip_filter(**filters))


# --- overview panels (the landing routes) -------------------------------------------
# Each takes the allow-listed role frames (sources.roles.roles(spark, sf_dir)).


def overview_summary(r: Mapping[str, DataFrame]) -> DataFrame:
    """AGG-1: table counts, on-time count and share, pending trips."""
    return K.home_summary(r["orders"], r["billing"], r["dispatch"], r["on_time"], r["trips"])


def monthly_freight(r: Mapping[str, DataFrame]) -> DataFrame:
    """AGG-8: trips and amount per creation month."""
    return R.monthly_freight(r["billing"])


def order_states(r: Mapping[str, DataFrame]) -> DataFrame:
    """AGG-17: orders per state, NULL state kept as a group."""
    return D.count_by(r["orders"], "estado", "keep")


def plant_dispatches(r: Mapping[str, DataFrame]) -> DataFrame:
    """AGG-18: dispatches per plant."""
    return D.count_by(r["dispatch"], "nom_planta", "keep")


def on_time_trend(r: Mapping[str, DataFrame]) -> DataFrame:
    """AGG-9: on/off/total per month."""
    return R.on_time_trend(r["on_time"])


def top_carriers(r: Mapping[str, DataFrame], k: int = 15) -> DataFrame:
    """TOP-1: the 15 companies with the largest amount."""
    return TK.top_companies(r["billing"], k)


def reconciliation(r: Mapping[str, DataFrame]) -> DataFrame:
    """AGG-19: billing rows per reconciliation state, NULL kept."""
    return D.count_by(r["billing"], "estado_conciliacion", "keep")


def pending_trips_by_zone(r: Mapping[str, DataFrame]) -> DataFrame:
    """AGG-20: pending trips and average compliance per zone (NULL zone dropped)."""
    return D.compliance_by(r["trips"], "zona", "drop_null", "cumplimiento_pct")


def table_preview(r: Mapping[str, DataFrame], name: str, n: int = 100, repeatable: bool = False) -> DataFrame:
    """SRC-2: ``n`` rows of an allow-listed table; any other name is an error."""
    return preview(r, name, n, repeatable=repeatable)


def table_info(r: Mapping[str, DataFrame]) -> DataFrame:
    """SRC-3: row count of every allow-listed table."""
    return table_counts({name: r[name] for name in ALLOWED_TABLES})
