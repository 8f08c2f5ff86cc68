"""Hand-written edge tables (FIXTURES.md section 3) with the role-frame schemas."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BILLING_SCHEMA = T.StructType([
    T.StructField("fecha_creacion", T.TimestampNTZType()),
    T.StructField("fecha", T.TimestampNTZType()),
    T.StructField("tarifa_final", T.DecimalType(18, 2)),
    *[T.StructField(c, T.StringType()) for c in (
        "nombre_compania", "compania", "nombre_sucursal", "transportista", "estado_contable", "estado_flt",
        "estado_flete", "estado_conciliacion", "status_crisar", "estado_envio_factura", "tipo_fact",
        "tipo_proceso", "aprobacion", "status_contabilidad_aje", "tipo_transporte", "como_factura", "motivo",
        "Filtro", "observacion", "titulo", "id_envio", "n_flete", "nro_factura", "estado_viaje")],
])

TRIPS_SCHEMA = T.StructType([
    *[T.StructField(c, T.StringType()) for c in (
        "referencia", "origen", "origen_carga", "destino", "destino_carga", "zona", "departamento",
        "cliente_final", "atencion", "empresa", "placa", "NS", "on_time", "estado_viaje")],
    T.StructField("dias_retrazo", T.IntegerType()),
    T.StructField("porcentaje_cumplimiento", T.DoubleType()),
    T.StructField("compromiso_de_carga", T.DateType()),
    T.StructField("fecha_carga", T.TimestampNTZType()),
    T.StructField("actualizacion", T.TimestampNTZType()),
])


def _frame(spark: SparkSession, schema: T.StructType, rows: list[dict]) -> DataFrame:
    names = [f.name for f in schema.fields]
    unknown = {k for r in rows for k in r} - set(names)
    assert not unknown, unknown
    data = []
    for r in rows:
        vals = []
        for f in schema.fields:
            v = r.get(f.name)
            if v is not None and isinstance(f.dataType, T.DecimalType) and not isinstance(v, Decimal):
                v = Decimal(str(v))
            vals.append(v)
        data.append(tuple(vals))
    return spark.createDataFrame(data, schema)


def billing(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return _frame(spark, BILLING_SCHEMA, rows)


def trips(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return _frame(spark, TRIPS_SCHEMA, rows)


def ts(s: str) -> datetime:
    return datetime.fromisoformat(s)


def d(s: str) -> date:
    return date.fromisoformat(s)
