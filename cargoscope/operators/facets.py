"""FCT-*: filter drop-down values, and SET-1: the four-group status panel.

The reference issues one query per facet column (12 scans for the billing
facets, 4 for the status panel). Here each is ONE scan: the columns are
unpivoted into long form (an ``Expand`` node), the blank policy is applied
explicitly (``DataFrame.unpivot`` does not drop NULLs), and a single hash
aggregate does the distinct / grouping for all facets at once, partially in
every task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.functions import measures as M
from cargoscope.functions.measure_sets import BillingMeasures, TripMeasures
from cargoscope.functions.predicates import blank_policy, present
from cargoscope.functions.scalars import month_key

# Facet names of the trip and billing filter drop-downs.
TRIP_FACETS = {"plantas": "origen_carga", "destinos": "destino_carga", "zonas": "zona"}
TRIP_FACETS_EXTENDED = {"origen_carga": "origen_carga", "destino_carga": "destino_carga", "zona": "zona",
                        "atencion": "atencion", "empresa": "empresa"}
FACT_FACETS = {
    "companias": "nombre_compania",
    "estados_contables": "estado_contable",
    "estados_flete": "estado_flete",
    "estados_flt": "estado_flt",
    "estados_conciliacion": "estado_conciliacion",
    "status_crisar": "status_crisar",
    "tipos_fact": "tipo_fact",
    "status_cont_aje": "status_contabilidad_aje",
    "aprobaciones": "aprobacion",
    "tipos_proceso": "tipo_proceso",
    "estados_envio_factura": "estado_envio_factura",
}
FREIGHT_FACET_COLUMNS = ("nombre_compania", "transportista", "estado_contable", "estado_flete",
                         "tipo_transporte", "estado_conciliacion", "nombre_sucursal")

# The four status groups of the panel and their columns.
STATUS_GROUPS = {"Contable": "estado_contable", "FLT": "estado_flt",
                 "Conciliacion": "estado_conciliacion", "Flete": "estado_flete"}


def _long_form(df: DataFrame, columns: dict[str, Column], ids: list[str], var: str, val: str) -> DataFrame:
    wide = df.select(*ids, *[c.cast("string").alias(name) for name, c in columns.items()])
    return wide.unpivot(ids or [], list(columns), var, val)


def facets(df: DataFrame, columns: dict[str, str], month_facets: dict[str, str] | None = None) -> DataFrame:
    """Distinct non-blank values of every facet column, as sorted ``(facet, val)`` rows.

    ``month_facets`` maps a facet name to a date column whose non-NULL months are listed.
    """
    cols = {name: F.col(c) for name, c in columns.items()}
    cols.update({name: month_key(c) for name, c in (month_facets or {}).items()})
    long = _long_form(df, cols, [], "facet", "val")
    return long.where(blank_policy("val", "drop_blank")).distinct().orderBy("facet", "val")


def facet_counts(facet_values: DataFrame) -> DataFrame:
    """FCT-3's printed count per facet."""
    return facet_values.groupBy("facet").agg(F.count(F.lit(1)).alias("n")).orderBy("facet")


def status_panel_rows(billing: DataFrame, groups: dict[str, str] = STATUS_GROUPS, amount: str = "tarifa_final",
                      where: Column | None = None) -> DataFrame:
    """SET-1 without the presentation order: trips and amount per (group, state).

    NULL states are dropped and '' is kept. One scan and one aggregate, equal to
    the UNION ALL of one GROUP BY per group.
    """
    if where is not None:
        billing = billing.where(where)
    m = BillingMeasures(amount=amount)
    long = _long_form(billing, {g: F.col(c) for g, c in groups.items()}, [amount], "grupo", "nombre")
    return long.where(present("nombre")).groupBy("grupo", "nombre").agg(m.trips("viajes"), m.total("total"))


def panel_order(panel: DataFrame) -> DataFrame:
    return panel.orderBy("grupo", F.col("total").desc_nulls_last(), "nombre")


def status_panel(billing: DataFrame, groups: dict[str, str] = STATUS_GROUPS, amount: str = "tarifa_final",
                 where: Column | None = None) -> DataFrame:
    """SET-1: the panel, ordered by group and amount."""
    return panel_order(status_panel_rows(billing, groups, amount, where))


# The category panels of the billing operations tab, with their blank policies.
OPERATIONS_PANELS = {
    "Contable": ("estado_contable", "drop_null"),
    "FLT": ("estado_flt", "drop_null"),
    "Conciliacion": ("estado_conciliacion", "drop_null"),
    "Flete": ("estado_flete", "drop_null"),
    "status_crisar": ("status_crisar", "drop_blank"),
    "estado_envio_factura": ("estado_envio_factura", "drop_blank"),
    "tipo_fact": ("tipo_fact", "drop_blank"),
    "aprobacion": ("aprobacion", "drop_blank"),
}


def category_panels(billing: DataFrame, panels: dict[str, tuple[str, str]] = OPERATIONS_PANELS,
                    amount: str = "tarifa_final", where: Column | None = None) -> DataFrame:
    """Several one-column panels (trips and amount per value) from ONE scan, in long form.

    Output ``(grupo, nombre, viajes, total)``; each panel keeps its own blank
    policy. The status panel (SET-1) and the tab's distributions (AGG-23..27)
    are all "per value of one column" over the same filtered fact, so one
    ``Expand`` and one partially aggregated group-by serve them all, instead of
    one query and one scan per panel. ``panel_group`` splits the result.
    """
    if where is not None:
        billing = billing.where(where)
    m = BillingMeasures(amount=amount)
    long = _long_form(billing, {g: F.col(c) for g, (c, _) in panels.items()}, [amount], "grupo", "nombre")
    keep = F.lit(False)
    for g, (_, blanks) in panels.items():
        keep = keep | ((F.col("grupo") == F.lit(g)) & blank_policy("nombre", blanks))
    out = long.where(keep).groupBy("grupo", "nombre").agg(m.trips("viajes"), m.total("total"))
    return panel_order(out)


# The trips dashboard's category panels (zone, department, delay bucket).
TRIP_PANELS = ("zona", "departamento", "rango")


def trip_panels(trips: DataFrame, where: Column | None = None) -> DataFrame:
    """The trips tab's zone, department and delay-bucket panels from ONE scan, in long form.

    Output ``(grupo, nombre, cantidad, cumpl, orden)``: trips, average compliance
    (exact half-up, 1 dp) and, for the buckets, the ordering key ``MIN(IFNULL(days, 0))``.
    Zone and department drop NULL and '' (AGG-21/22); every bucket is kept (BKT-1).
    """
    from cargoscope.operators.buckets import delay_bucket

    if where is not None:
        trips = trips.where(where)
    wide = trips.select(F.col("zona"), F.col("departamento"), delay_bucket("dias_retrazo").alias("rango"),
                        "porcentaje_cumplimiento", F.coalesce(F.col("dias_retrazo"), F.lit(0)).alias("_dias"))
    long = wide.unpivot(["porcentaje_cumplimiento", "_dias"], list(TRIP_PANELS), "grupo", "nombre")
    keep = (F.col("grupo") == F.lit("rango")) | blank_policy("nombre", "drop_blank")
    t = TripMeasures()
    out = M.aggregate(long.where(keep).groupBy("grupo", "nombre"),
                      M.rows().alias("cantidad"), t.compliance_avg("cumpl"), F.min("_dias").alias("orden"))
    return out.orderBy("grupo", F.col("cantidad").desc(), "nombre")


def panel_group(panel: DataFrame, grupo: str) -> DataFrame:
    """SET-2: one group of the status panel (the dashboard splits the panel by its tag)."""
    return panel.where(F.col("grupo") == F.lit(grupo))


def status_panel_union(billing: DataFrame, groups: dict[str, str] = STATUS_GROUPS, amount: str = "tarifa_final",
                       where: Column | None = None) -> DataFrame:
    """SET-1 written as the reference writes it: one scan per group, UNION ALL.

    Kept for the equivalence test and the one-scan-vs-N-scan benchmark.
    """
    if where is not None:
        billing = billing.where(where)
    m = BillingMeasures(amount=amount)
    parts = [
        billing.where(present(c)).groupBy(F.col(c).alias("nombre"))
        .agg(m.trips("viajes"), m.total("total"))
        .select(F.lit(g).alias("grupo"), "nombre", "viajes", "total")
        for g, c in groups.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
