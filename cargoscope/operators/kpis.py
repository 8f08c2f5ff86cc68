"""AGG-1..7: global KPI rows (no group key, exactly one row even on empty input).

Each is a single ``agg`` over one scan: Spark computes partial aggregates in
every task and merges one row per task, so the work is fully parallel and the
shuffle is a handful of rows however large the table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.functions import measures as M
from cargoscope.functions.measure_sets import BillingMeasures, TripMeasures
from cargoscope.functions.predicates import has_value, not_blank, present
from cargoscope.functions.vocabulary import BILLING, TRIPS, BillingStates, TripStates


def home_summary(orders: DataFrame, freight: DataFrame, dispatch: DataFrame, on_time: DataFrame,
                 trips: DataFrame, on_time_label: str = TRIPS.on_time) -> DataFrame:
    """AGG-1: four table counts, the on-time count and share, pending trips.

    The on-time report is scanned once for both of its counts. The one-row
    partial results are stacked as (name, value) rows and folded into one row by
    a final aggregate, so no cross join is needed.
    """
    def tagged(df: DataFrame, **measures) -> DataFrame:
        agg = df.agg(*[c.alias(k) for k, c in measures.items()])
        stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in measures]))
        return agg.select(stacked.alias("kv")).select("kv.k", "kv.v")

    long = (
        tagged(orders, total_oc=M.rows())
        .unionByName(tagged(freight, total_fletes=M.rows()))
        .unionByName(tagged(dispatch, total_despachos=M.rows()))
        .unionByName(tagged(on_time, total_on_time=M.count_where(F.col("on_time") == on_time_label),
                            total_ot=M.rows()))
        .unionByName(tagged(trips, total_viajes_pend=M.rows()))
    )
    pick = {k: F.sum(F.when(F.col("k") == k, F.col("v"))) for k in
            ("total_oc", "total_fletes", "total_despachos", "total_on_time", "total_ot", "total_viajes_pend")}
    folded = long.agg(*[c.alias(k) for k, c in pick.items()])
    return folded.select(
        "total_oc", "total_fletes", "total_despachos", "total_on_time",
        M.count_share_of("total_on_time", "total_ot", zero=True).alias("on_time_pct"),
        "total_viajes_pend",
    )


def trip_kpis(trips: DataFrame, states: TripStates = TRIPS) -> DataFrame:
    """AGG-2: trip KPI row; shares and averages fall back to 0 (R4, R17)."""
    m = TripMeasures(states)
    agg = M.aggregate(
        trips,
        M.rows().alias("total"),
        M.count_where(m.ns_is(states.on_time)).alias("on_time_ct"),
        M.count_where(m.ns_is(states.off_time)).alias("off_time_ct"),
        m.compliance_avg("cumpl_prom"),
        m.delay_avg("retraso_prom"),
        M.count_where(has_value("placa", states.plate_sentinels)).alias("con_placa"),
        F.max("actualizacion").alias("ultima_actualizacion"),
    )
    return agg.select(
        "total", "on_time_ct", "off_time_ct",
        M.count_share_of("on_time_ct", "total", zero=True).alias("on_time_pct"),
        M.count_share_of("off_time_ct", "total", zero=True).alias("off_time_pct"),
        M.or_zero(F.col("cumpl_prom")).alias("cumpl_prom"),
        M.or_zero(F.col("retraso_prom")).alias("retraso_prom"),
        "con_placa",
        M.count_share_of("con_placa", "total", zero=True).alias("con_placa_pct"),
        "ultima_actualizacion",
    )


def billing_kpi_sums(states: BillingStates = BILLING, amount: str = "tarifa_final") -> list[Column | M.Ratio]:
    """The measures of AGG-3 but the distinct count: sums, counts and ratios of them."""
    m = BillingMeasures(states, amount)
    s = states
    return [
        m.trips("total_viajes"),
        m.total("tarifa_total"),
        m.avg("tarifa_prom"),
        *m.state_block(m.billed, "facturados", "facturado_total", "pct_facturado"),
        *m.state_block(m.unbilled, "sin_facturar", "sin_facturar_total", "pct_sin_facturar"),
        *m.state_block(m.cancelled, "anulados", "anulado_total", "pct_anulado"),
        m.count_if(m.is_("estado_flt", s.with_flt), "con_flt"),
        m.count_if(m.is_("estado_flete", s.confirmed), "confirmados"),
        m.count_if(m.is_("estado_flete", s.to_confirm), "por_confirmar"),
        *m.state_block(m.collected, "cobrados", "cobrado_total"),
    ]


def billing_kpis(billing: DataFrame, states: BillingStates = BILLING, amount: str = "tarifa_final") -> DataFrame:
    """AGG-3: the 18-measure billing KPI row."""
    trips, *sums = billing_kpi_sums(states, amount)
    return M.aggregate(billing, trips, M.distinct_count("nombre_compania").alias("companias"), *sums)


def executive_measures(states: BillingStates = BILLING, amount: str = "tarifa_final") -> list:
    """The 21 measures of AGG-4; the monthly trend (AGG-10) and company ranking (AGG-39) use subsets."""
    m = BillingMeasures(states, amount)
    s = states
    return [
        m.trips("total_viajes"),
        m.total("total_tarifa"),
        m.avg("tarifa_prom"),
        M.distinct_count("nombre_compania").alias("companias"),
        *m.state_block(m.billed, "fact_viajes", "fact_total", "pct_facturado"),
        *m.state_block(m.unbilled, "pend_viajes", "pend_total", "pct_sin_facturar"),
        *m.state_block(m.cancelled, "anul_viajes", "anul_total", "pct_anulado"),
        *m.state_block(m.collected, "cob_viajes", "cob_total", "pct_cobrado"),
        m.count_if(m.is_("estado_flt", s.with_flt), "con_flt"),
        m.count_if(m.is_("estado_flt", s.without_flt), "sin_flt"),
        m.count_if(m.is_("estado_envio_factura", s.accepted), "env_aceptados"),
        m.count_if(m.is_("estado_flete", s.confirmed), "conf_viajes"),
        m.count_if(m.is_("estado_flete", s.to_confirm), "por_confirmar"),
    ]


def executive_summary(billing: DataFrame, states: BillingStates = BILLING, amount: str = "tarifa_final") -> DataFrame:
    """AGG-4: 21 measures, a superset of AGG-3 with collected share, without-FLT and accepted dispatches."""
    return M.aggregate(billing, *executive_measures(states, amount))


# The commercial tab's groupings and how each renames the executive measures.
COMMERCIAL_PANELS = {
    "resumen": {},
    "mes": {"clave": "mes", "total_tarifa": "total", "fact_total": "facturado", "pend_total": "pendiente",
            "cob_total": "cobrado", "pct_facturado": "pct_fact", "pct_cobrado": "pct_cobrado",
            "total_viajes": "viajes", "conf_viajes": "confirmados", "con_flt": "con_flt"},
    "compania": {"clave": "nombre_compania", "total_viajes": "viajes", "total_tarifa": "total",
                 "fact_total": "facturado", "pend_total": "pendiente", "anul_total": "anulado",
                 "cob_total": "cobrado", "pct_facturado": "pct_fact", "pct_cobrado": "pct_cobrado",
                 "tarifa_prom": "promedio"},
    "status_cont_aje": {"clave": "status_contabilidad_aje", "total_viajes": "viajes", "total_tarifa": "total"},
}


def commercial_panels(billing: DataFrame, states: BillingStates = BILLING, amount: str = "tarifa_final",
                      where=None) -> DataFrame:
    """AGG-4, AGG-10, AGG-39 and AGG-26 from ONE scan, in long form ``(grupo, clave, <21 measures>)``.

    Each row of the (filtered) fact is expanded into the groupings it belongs to:
    the whole table, its creation month (dated rows), its company (named rows)
    and its ledger status (non-blank rows). One aggregate computes the executive
    measures per (grouping, key); the monthly trend, the company ranking and the
    ledger distribution are renamed subsets (``COMMERCIAL_PANELS``). Unlike
    ``executive_summary``, an empty input yields no ``resumen`` row.
    """
    from cargoscope.functions.scalars import month_key

    if where is not None:
        billing = billing.where(where)
    groupings = {
        "resumen": (F.lit(None).cast("string"), F.lit(True)),
        "mes": (month_key("fecha_creacion"), present("fecha_creacion")),
        "compania": (F.col("nombre_compania"), present("nombre_compania")),
        "status_cont_aje": (F.col("status_contabilidad_aje"), not_blank("status_contabilidad_aje")),
    }
    inputs = [amount, "nombre_compania", "estado_contable", "status_crisar", "estado_flt", "estado_envio_factura",
              "estado_flete"]
    tags = {g: F.struct(cond.alias("member"), key.cast("string").alias("key")) for g, (key, cond) in groupings.items()}
    long = (billing.select(*inputs, *[t.alias(g) for g, t in tags.items()])
            .unpivot(inputs, list(tags), "grupo", "_g")
            .where(F.col("_g.member"))
            .withColumn("clave", F.col("_g.key")))
    return M.aggregate(long.groupBy("grupo", "clave"), *executive_measures(states, amount))


def freight_kpis(freight: DataFrame, states: BillingStates = BILLING, amount: str = "tarifa_final") -> DataFrame:
    """AGG-5: freight profile. ``!=`` drops NULL (FLT-9); the reconciled complement keeps it."""
    m = BillingMeasures(states, amount)
    s = states
    rec = F.col("estado_conciliacion")
    flete = F.col("estado_flete")
    return M.aggregate(
        freight,
        m.trips("total_fletes"),
        M.distinct_count("transportista").alias("transportistas"),
        M.distinct_count("compania").alias("companias"),
        m.total("tarifa_total"),
        m.avg("tarifa_prom"),
        m.min("tarifa_min"),
        m.max("tarifa_max"),
        m.count_if(rec == s.reconciled, "conciliados"),
        m.count_if((rec != s.reconciled) | rec.isNull(), "no_conciliados"),
        m.count_if(flete == s.freight_billed, "facturados"),
        m.count_if(flete != s.freight_billed, "no_facturados"),
    )


def validation_kpis(validated: DataFrame, states: BillingStates = BILLING, amount: str = "tarifa_final") -> DataFrame:
    """AGG-6: validated-freight profile."""
    m = BillingMeasures(states, amount)
    return M.aggregate(
        validated,
        m.trips("total"),
        *m.state_block(m.billed, "fact_viajes", "fact_total"),
        *m.state_block(m.unbilled, "pend_viajes", "pend_total"),
        *m.state_block(m.cancelled, "anul_viajes", "anul_total"),
        m.total("tarifa_total"),
        m.avg("tarifa_prom"),
        m.count_if(not_blank("status_crisar"), "con_status"),
    )


def date_ranges(freight: DataFrame, a: str = "fecha", b: str = "fecha_creacion") -> DataFrame:
    """AGG-7: min/max of two date columns."""
    return freight.agg(
        F.min(a).alias("min_f"), F.max(a).alias("max_f"),
        F.min(b).alias("min_fc"), F.max(b).alias("max_fc"),
    )
