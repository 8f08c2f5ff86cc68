"""AGG-39..42: conditional measures per company or carrier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.functions import measures as M
from cargoscope.functions.measure_sets import BillingMeasures
from cargoscope.functions.predicates import not_blank, present
from cargoscope.functions.vocabulary import BILLING, BillingStates
from cargoscope.operators.rollups import billed_share, view_measures


def scorecard(df: DataFrame, key: str, keep: Column, measures: list[Column], order_by: str,
              where: Column | None = None) -> DataFrame:
    """Measures per ``key`` for rows passing ``keep``; sorted by ``order_by`` desc, key asc."""
    if where is not None:
        df = df.where(where)
    out = M.aggregate(df.where(keep).groupBy(key), *measures)
    return out.orderBy(F.col(order_by).desc_nulls_last(), F.col(key).asc_nulls_first())


def company_ranking(billing: DataFrame, states: BillingStates = BILLING, amount: str = "tarifa_final",
                    where: Column | None = None) -> DataFrame:
    """AGG-39: the billing panel's company ranking (takes the FLT-3/4 filter)."""
    m = BillingMeasures(states, amount)
    return scorecard(billing, "nombre_compania", present("nombre_compania"), [
        m.trips("viajes"),
        m.total("total"),
        m.amount_if(m.billed, "facturado"),
        m.amount_if(m.unbilled, "pendiente"),
        m.amount_if(m.cancelled, "anulado"),
        m.amount_if(m.collected, "cobrado"),
        m.share_if(m.billed, "pct_fact"),
        m.share_if(m.collected, "pct_cobrado"),
        m.avg("promedio"),
    ], "total", where=where)


def view_company(validated: DataFrame, states: BillingStates = BILLING, amount: str = "tarifa_final") -> DataFrame:
    """AGG-40: company view, billed amount descending."""
    return scorecard(validated, "nombre_compania", present("nombre_compania"),
                     [*view_measures(states, amount), billed_share(states, amount)], "fact_total")


def view_carrier(validated: DataFrame, states: BillingStates = BILLING, amount: str = "tarifa_final") -> DataFrame:
    """AGG-41: carrier view (blank carriers dropped), total amount descending."""
    return scorecard(validated, "transportista", not_blank("transportista"), view_measures(states, amount), "total_tarifa")


def company_billing(billing: DataFrame, states: BillingStates = BILLING, amount: str = "tarifa_final") -> DataFrame:
    """AGG-42: billed / unbilled / cancelled count and amount per company."""
    m = BillingMeasures(states, amount)
    return scorecard(billing, "nombre_compania", present("nombre_compania"), [
        *m.state_block(m.billed, "fact_viajes", "fact_total"),
        *m.state_block(m.unbilled, "pend_viajes", "pend_total"),
        *m.state_block(m.cancelled, "anul_viajes", "anul_total"),
    ], "fact_total")
