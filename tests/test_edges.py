
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cargoscope.functions import measures as M
from cargoscope.functions.predicates import (due_soon, fact_filter, has_value, month_range, not_blank, present,
                                             trip_filter)
from cargoscope.functions.scalars import fallback, or_default, short_label, to_edge
from cargoscope.functions.tags import accounting_tag, collection_tag, compliance_band, dispatch_tag
from cargoscope.operators import distributions as D
from cargoscope.operators import kpis as K
from cargoscope.operators import rollups as R
from cargoscope.operators import topk as TK
from cargoscope.operators.buckets import delay_buckets
from cargoscope.operators.detail import fact_page, page
from tests import frames as FR


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# R1: three blank policies on one table -----------------------------------------------

@pytest.fixture()
def categories(spark):
    return FR.billing(spark, [
        {"estado_conciliacion": "a", "tarifa_final": "1.00"},
        {"estado_conciliacion": "a", "tarifa_final": None},
        {"estado_conciliacion": "b", "tarifa_final": "2.50"},
        {"estado_conciliacion": "", "tarifa_final": "4.00"},
        {"estado_conciliacion": None, "tarifa_final": "8.00"},
    ])


def test_blank_policies(categories):
    keep = {r[0]: r[1] for r in rows(D.count_by(categories, "estado_conciliacion", "keep"),
                                      "estado_conciliacion", "cantidad")}
    assert keep == {"a": 2, "b": 1, "": 1, None: 1}
    drop_null = {r[0] for r in rows(D.count_by(categories, "estado_conciliacion", "drop_null"), "estado_conciliacion")}
    assert drop_null == {"a", "b", ""}
    drop_blank = {r[0] for r in rows(D.count_by(categories, "estado_conciliacion", "drop_blank"),
                                     "estado_conciliacion")}
    assert drop_blank == {"a", "b"}


def test_blank_policy_is_required(categories):
    with pytest.raises(ValueError):
        D.count_by(categories, "estado_conciliacion", "default")


def test_null_amount_is_skipped_by_sum_and_avg(categories):
    out = to_edge(D.amount_by(categories, "estado_conciliacion", "drop_blank", with_avg=True))
    got = {r[0]: (r[1], r[2], r[3]) for r in rows(out, "estado_conciliacion", "viajes", "total", "promedio")}
    assert got["a"] == (2, 1.0, 1.0)   # the NULL amount counts as a trip, not in sum/avg
    assert got["b"] == (1, 2.5, 2.5)


# R2: COUNTIF(x != v) skips NULL ---------------------------------------------------------

def test_not_equal_skips_null(spark):
    on_time = spark.createDataFrame(
        [(FR.ts("2000-01-05"), "ON TIME"), (FR.ts("2000-01-06"), "OFF TIME"), (FR.ts("2000-01-07"), None),
         (None, "ON TIME")], "fecha timestamp_ntz, on_time string")
    (mes, on, off, total), = rows(R.on_time_trend(on_time), "mes", "on_time", "off_time", "total")
    assert (mes, on, off, total) == ("2000-01", 1, 1, 3)   # NULL status only in the total; NULL date dropped


# R3 / R17: empty input ----------------------------------------------------------------------

def test_empty_input_gives_one_kpi_row(spark):
    empty = FR.billing(spark, [])
    r = to_edge(K.billing_kpis(empty)).collect()
    assert len(r) == 1
    assert r[0]["total_viajes"] == 0 and r[0]["facturados"] == 0
    assert r[0]["facturado_total"] is None and r[0]["pct_facturado"] is None and r[0]["tarifa_prom"] is None
    t = K.trip_kpis(FR.trips(spark, [])).collect()[0]
    assert (t["total"], t["on_time_pct"], t["cumpl_prom"], t["retraso_prom"]) == (0, 0.0, 0.0, 0.0)


def test_sum_if_is_zero_for_a_group_without_match(spark):
    df = FR.billing(spark, [{"fecha": FR.ts("2001-01-01"), "estado_contable": "Anulado", "tarifa_final": "3.00"}])
    r = to_edge(R.monthly_billing(df)).collect()[0]
    assert r["fact_viajes"] == 0 and r["fact_total"] == 0.0


# R4 / R6: zero denominators ---------------------------------------------------------------

def test_zero_total_share_is_null_not_an_error(spark):
    df = FR.billing(spark, [
        {"fecha": FR.ts("2001-02-01"), "estado_contable": "Facturado", "tarifa_final": "0.00"},
        {"fecha": FR.ts("2001-02-02"), "estado_contable": "Sin Facturar", "tarifa_final": "0.00"},
    ])
    r = R.monthly_pct_billed(df).collect()[0]
    assert r["pct_facturado"] is None


# R5: exact half-up rounding ----------------------------------------------------------------

def test_half_up_rounding_on_exact_ties(spark):
    df = FR.billing(spark, [
        {"nombre_compania": "x", "tarifa_final": "1.00"}, {"nombre_compania": "x", "tarifa_final": "1.01"},  # 1.005
        {"nombre_compania": "y", "tarifa_final": "0.12"}, {"nombre_compania": "y", "tarifa_final": "0.13"},  # 0.125
        {"nombre_compania": "z", "tarifa_final": "-1.00"}, {"nombre_compania": "z", "tarifa_final": "-1.01"},
    ])
    got = {r[0]: r[1] for r in rows(D.amount_by(df, "nombre_compania", "drop_null", with_avg=True),
                                     "nombre_compania", "promedio")}
    assert got == {"x": 1.01, "y": 0.13, "z": -1.01}


def test_ratio_half_up_matches_decimal_arithmetic(spark):
    from decimal import ROUND_HALF_UP, Decimal
    pairs = [(n, d) for n in (-7, -5, -1, 0, 1, 5, 7, 125, 999, 10 ** 12 + 5) for d in (-8, -2, 1, 2, 3, 8, 16, 40)]
    df = spark.createDataFrame(pairs, "n long, d long")
    out = df.select("n", "d", M.ratio_half_up(F.col("n"), F.col("d"), 2).alias("r")).collect()
    for r in out:
        want = float((Decimal(r["n"]) / Decimal(r["d"])).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))
        assert r["r"] == want, (r["n"], r["d"], r["r"], want)
    z = spark.createDataFrame([(1, 0)], "n long, d long").select(M.ratio_half_up(F.col("n"), F.col("d"), 1)).first()
    assert z[0] is None


# R7 / R8: NULL order and ties before a limit ---------------------------------------------

def test_ties_are_broken_by_the_output_key(spark):
    df = FR.billing(spark, [{"nombre_compania": c, "tarifa_final": "5.00"} for c in ("d", "b", "a", "c")])
    top = rows(TK.top_companies(df, k=2), "nombre_compania")
    assert top == [("a",), ("b",)]


def test_null_compliance_sorts_first_and_reference_descending(spark):
    df = FR.trips(spark, [
        {"referencia": "1", "porcentaje_cumplimiento": 90.0},
        {"referencia": "2", "porcentaje_cumplimiento": None},
        {"referencia": "3", "porcentaje_cumplimiento": 90.0},
        {"referencia": "4", "porcentaje_cumplimiento": 80.0},
    ])
    assert [r[0] for r in rows(TK.trip_table(df), "referencia")] == ["2", "4", "3", "1"]


def test_due_soon_null_commitment_first(spark):
    df = FR.trips(spark, [
        {"referencia": "a", "NS": "OFF TIME", "compromiso_de_carga": None},
        {"referencia": "b", "NS": "ON TIME", "compromiso_de_carga": FR.d("1998-07-02")},   # as_of + 2: due
        {"referencia": "c", "NS": "ON TIME", "compromiso_de_carga": FR.d("1998-07-03")},   # too late
        {"referencia": "d", "NS": "ON TIME", "compromiso_de_carga": None},                 # not due
        {"referencia": "e", "NS": "OFF TIME", "compromiso_de_carga": FR.d("1999-01-01")},
    ])
    got = [r[0] for r in rows(TK.trips_due_soon(df, "1998-06-30"), "referencia")]
    assert got == ["a", "b", "e"]


# R9 / BKT-1: bucket edges -----------------------------------------------------------------

def test_delay_bucket_edges(spark):
    days = [-1, 0, 1, 3, 4, 7, 8, None]
    df = FR.trips(spark, [{"dias_retrazo": x} for x in days])
    got = rows(delay_buckets(df), "rango", "cantidad")
    assert got == [("A tiempo", 3), ("1-3 días", 2), ("4-7 días", 2), ("+7 días", 1)]


# FLT-4: month edges ------------------------------------------------------------------------

def test_month_range_edges(spark):
    stamps = ["2000-02-01 00:00:00", "2000-02-29 23:59:59.999999", "2000-03-01 00:00:00", "1999-12-31 23:59:59",
              "2000-01-31 23:59:59.999999"]
    df = spark.createDataFrame([(FR.ts(s),) for s in stamps] + [(None,)], "fecha_creacion timestamp_ntz")
    kept = sorted(str(r[0]) for r in df.where(month_range("fecha_creacion", "2000-01", "2000-02")).collect())
    assert kept == ["2000-01-31 23:59:59.999999", "2000-02-01 00:00:00", "2000-02-29 23:59:59.999999"]
    dec = df.where(month_range("fecha_creacion", "1999-12", "1999-12")).count()
    assert dec == 1
    with pytest.raises(ValueError):
        month_range("fecha_creacion", "2000-13", "")


# PAG-1: paging -----------------------------------------------------------------------------

def test_pages_concatenate_to_the_whole(spark):
    df = FR.billing(spark, [{"fecha_creacion": FR.ts(f"2000-01-{1 + i % 28:02d}"), "id_envio": str(i)}
                            for i in range(101)])
    whole = rows(fact_page(df, 1, 200), "id_envio")
    pages = [rows(fact_page(df, p, 50), "id_envio") for p in (1, 2, 3)]
    assert [len(p) for p in pages] == [50, 50, 1]
    assert sum(pages, []) == whole
    assert rows(fact_page(df, 101, 1), "id_envio") == whole[100:]
    for bad in ((0, 50), (1, 0), (-1, 5)):
        with pytest.raises(ValueError):
            fact_page(df, *bad)
    with pytest.raises(ValueError):
        page(df, [], 1, 0)


def test_average_delay_keeps_fractions(spark):
    from cargoscope.functions.measure_sets import TripMeasures
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "dias_retrazo double")
    assert M.aggregate(df.groupBy(), TripMeasures().delay_avg("d")).first()["d"] == 1.5


# FLT-7 sentinels, FLT-1/3 filters -----------------------------------------------------------

def test_plate_sentinels(spark):
    df = FR.trips(spark, [{"placa": p} for p in (None, "", "---", " ", "ABC-123")])
    assert df.where(has_value("placa")).count() == 2
    assert df.where(not_blank("placa")).count() == 3
    assert df.where(present("placa")).count() == 4


def test_filters_and_together_and_empty_means_none(spark):
    df = FR.trips(spark, [
        {"origen_carga": "P1", "zona": "Z1", "NS": "ON TIME"},
        {"origen_carga": "P1", "zona": "Z2", "NS": "OFF TIME"},
        {"origen_carga": "P2", "zona": None, "NS": "OFF TIME"},
    ])
    assert df.where(trip_filter()).count() == 3
    assert df.where(trip_filter(planta="P1")).count() == 2
    assert df.where(trip_filter(planta="P1", ns="OFF_TIME")).count() == 1
    assert df.where(trip_filter(ns="NOT_A_CODE")).count() == 3     # unknown code ignored
    assert df.where(trip_filter(zona="Z1")).count() == 1            # equality drops the NULL zone


def test_fact_filter_rejects_unknown_arguments():
    with pytest.raises(TypeError):
        fact_filter(compania_typo="x")


def test_due_soon_defaults_to_today(spark):
    df = FR.trips(spark, [{"NS": "ON TIME", "compromiso_de_carga": FR.d("1990-01-01")},
                          {"NS": "ON TIME", "compromiso_de_carga": FR.d("2999-01-01")}])
    assert df.where(due_soon()).count() == 1


# DRV-6/7 and SCL-16..18 ----------------------------------------------------------------------

def test_tags_and_labels(spark):
    df = spark.createDataFrame(
        [("Facturado", "COBRADO", "ACEPTADO", 100.0, "abcdef", None),
         ("Anulado", "", "PENDIENTE", 95.0, "", "x"),
         (None, None, "raro", None, None, "")],
        "ec string, sc string, env string, c double, s string, t string")
    out = df.select(accounting_tag("ec").alias("a"), collection_tag("sc").alias("b"), dispatch_tag("env").alias("e"),
                    compliance_band("c").alias("band"), short_label("s", 3).alias("l"),
                    or_default("s").alias("dflt"), fallback("t", "s").alias("fb")).collect()
    assert [tuple(r) for r in out] == [
        ("Fact", "cbr", "acp", "grn", "abc", "abcdef", "abcdef"),
        ("Anul", "-", "pen", "orn", "", "N/A", "x"),
        ("Pend", "-", "man", "red", None, "N/A", None),
    ]


def test_fractional_delays_fall_through_to_the_overflow_bucket(spark):
    from cargoscope.operators.buckets import delay_bucket
    df = spark.createDataFrame([(x,) for x in (0.5, 1.0, 3.5, 4.0, 7.5, 8.0, -0.5)], "d double")
    got = dict((r["d"], r["b"]) for r in df.select("d", delay_bucket("d").alias("b")).collect())
    assert got == {0.5: "+7 días", 1.0: "1-3 días", 3.5: "+7 días", 4.0: "4-7 días", 7.5: "+7 días",
                   8.0: "+7 días", -0.5: "A tiempo"}                       # R9, kept as written


def test_month_range_on_either_date_column(spark):
    df = FR.billing(spark, [{"fecha_creacion": FR.ts("2000-01-15"), "fecha": FR.ts("2000-03-15")},
                            {"fecha_creacion": FR.ts("2000-03-15"), "fecha": FR.ts("2000-01-15")}])
    by_created = df.where(fact_filter(mes_desde="2000-03", mes_hasta="2000-03")).collect()
    by_shipped = df.where(fact_filter(mes_desde="2000-03", mes_hasta="2000-03", date_col="fecha")).collect()
    assert [r["fecha_creacion"] for r in by_created] == [FR.ts("2000-03-15")]      # R14: the column is a parameter
    assert [r["fecha"] for r in by_shipped] == [FR.ts("2000-03-15")]
