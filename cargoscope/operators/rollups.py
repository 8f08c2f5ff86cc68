"""AGG-8..16: monthly rollups keyed by ``yyyy-MM``, NULL dates dropped, ascending.

``groupBy(month)`` is a hash aggregate with map-side partial aggregation: each
task emits at most one row per month, so even a month holding a third of all
rows costs one row per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.functions import measures as M
from cargoscope.functions.measure_sets import BillingMeasures
from cargoscope.functions.predicates import present
from cargoscope.functions.scalars import month_key, month_start
from cargoscope.functions.vocabulary import BILLING, TRIPS, BillingStates


def monthly(df: DataFrame, date_col: str, measures: list[Column], extra_keys: list[Column] = (),
            where: Column | None = None) -> DataFrame:
    """Group non-NULL ``date_col`` rows by month (plus ``extra_keys``) and sort by month."""
    if where is not None:
        df = df.where(where)
    keys = [month_key(date_col).alias("mes"), *extra_keys]
    out = M.aggregate(df.where(present(date_col)).groupBy(*keys), *measures)
    names = [k for k in out.columns[: len(keys)]]
    return out.orderBy(*[F.col(n).asc_nulls_first() for n in names])


def monthly_freight(billing: DataFrame, amount: str = "tarifa_final") -> DataFrame:
    """AGG-8: count and amount per creation month."""
    m = BillingMeasures(amount=amount)
    return monthly(billing, "fecha_creacion", [m.trips("cantidad"), m.total("total_tarifas")])


def on_time_trend(on_time: DataFrame, label: str = TRIPS.on_time) -> DataFrame:
    """AGG-9: on/off/total per month. ``!=`` skips NULL, so on + off can be < total (R2)."""
    s = F.col("on_time")
    return monthly(on_time, "fecha", [
        M.count_where(s == label).alias("on_time"),
        M.count_where(s != label).alias("off_time"),
        M.rows().alias("total"),
    ])


def monthly_trend(billing: DataFrame, states: BillingStates = BILLING, amount: str = "tarifa_final",
                  where: Column | None = None) -> DataFrame:
    """AGG-10: the billing panel's monthly trend (takes the FLT-3/4 filter)."""
    m = BillingMeasures(states, amount)
    s = states
    return monthly(billing, "fecha_creacion", [
        m.total("total"),
        m.amount_if(m.billed, "facturado"),
        m.amount_if(m.unbilled, "pendiente"),
        m.amount_if(m.collected, "cobrado"),
        m.share_if(m.billed, "pct_fact"),
        m.share_if(m.collected, "pct_cobrado"),
        m.trips("viajes"),
        m.count_if(m.is_("estado_flete", s.confirmed), "confirmados"),
        m.count_if(m.is_("estado_flt", s.with_flt), "con_flt"),
    ], where=where)


def view_measures(states: BillingStates = BILLING, amount: str = "tarifa_final") -> list[Column | M.Ratio]:
    """Trips, amount, average, and count and amount of the billed and unbilled: the measures of three saved views."""
    m = BillingMeasures(states, amount)
    return [
        m.trips("total_viajes"),
        m.total("total_tarifa"),
        m.avg("tarifa_promedio"),
        *m.state_block(m.billed, "fact_viajes", "fact_total"),
        *m.state_block(m.unbilled, "pend_viajes", "pend_total"),
    ]


def billed_share(states: BillingStates = BILLING, amount: str = "tarifa_final") -> M.Ratio:
    m = BillingMeasures(states, amount)
    return m.share_if(m.billed, "pct_facturado")


def view_monthly(validated: DataFrame, states: BillingStates = BILLING, amount: str = "tarifa_final") -> DataFrame:
    """AGG-11: monthly view with a second key, the month's first instant."""
    return monthly(validated, "fecha", [*view_measures(states, amount), billed_share(states, amount)],
                   extra_keys=[month_start("fecha").alias("mes_date")])


def on_time_measures(states: BillingStates = BILLING) -> list[Column]:
    arrived = M.count_where(F.col("estado_viaje") == states.arrived_on_time)
    return [M.rows().alias("total_viajes"), arrived.alias("on_time")]


def view_on_time(validated: DataFrame, states: BillingStates = BILLING) -> DataFrame:
    """AGG-12: per (month, company): trips, arrived on time, on-time share."""
    out = monthly(validated, "fecha", on_time_measures(states),
                  extra_keys=[F.col("nombre_compania")], where=present("estado_viaje"))
    return out.withColumn("pct_on_time", M.count_share_of("on_time", "total_viajes"))


def monthly_billing(billing: DataFrame, states: BillingStates = BILLING, amount: str = "tarifa_final") -> DataFrame:
    """AGG-13: billed / unbilled count and amount per month."""
    m = BillingMeasures(states, amount)
    return monthly(billing, "fecha", [
        *m.state_block(m.billed, "fact_viajes", "fact_total"),
        *m.state_block(m.unbilled, "pend_viajes", "pend_total"),
    ])


def monthly_pct_billed(billing: DataFrame, states: BillingStates = BILLING, amount: str = "tarifa_final") -> DataFrame:
    """AGG-14: billed share per month, NULL when the month's total is 0 (NULLIF guard)."""
    m = BillingMeasures(states, amount)
    return monthly(billing, "fecha", [m.share_if(m.billed, "pct_facturado")])


def monthly_fare(freight: DataFrame, amount: str = "tarifa_final") -> DataFrame:
    """AGG-15: count, amount, average amount per month."""
    m = BillingMeasures(amount=amount)
    return monthly(freight, "fecha", [m.trips("viajes"), m.total("total"), m.avg("promedio")])


def monthly_first(freight: DataFrame, n: int = 3) -> DataFrame:
    """AGG-16: row count of the first ``n`` months (the connectivity smoke query)."""
    return monthly(freight, "fecha", [M.rows().alias("cantidad")]).limit(n)
