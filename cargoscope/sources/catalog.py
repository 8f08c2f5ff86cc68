"""SRC-2..4 and JOIN-1: preview, row counts, column listings and a schema diff."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoscope.operators.topk import top_k


# Tables that a user may look into; the billing fact itself is not one of them.
ALLOWED_TABLES = ("trips", "on_time", "orders", "dispatch", "freight", "validated")


def preview(tables: Mapping[str, DataFrame], name: str, n: int = 100, repeatable: bool = False,
            allowed: tuple[str, ...] = ALLOWED_TABLES) -> DataFrame:
    """SRC-2: ``n`` rows of an allow-listed table; an unknown name is an error.

    Any ``n`` rows by default, which reads no more than it shows. ``repeatable``
    gives the first ``n`` in the order of all columns instead, planned as a top-k
    (each task keeps ``n`` rows).
    """
    if name not in allowed:
        raise KeyError(f"table {name!r} is not in the allow-list")
    return top_k(tables[name], [], n) if repeatable else tables[name].limit(n)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """SRC-3: ``(nombre, filas)`` for every table: one partial count per task per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("filas")).select(F.lit(name).alias("nombre"), "filas")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_SQL_TYPE_NAMES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT",
    "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "binary": "BLOB",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def sql_type_name(dtype: T.DataType) -> str:
    simple = dtype.simpleString()
    return _SQL_TYPE_NAMES.get(simple, simple.upper())


_COLUMNS_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("ordinal_position", T.IntegerType(), False),
    T.StructField("data_type", T.StringType(), False),
    T.StructField("is_nullable", T.StringType(), False),
])


def describe_columns(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """SRC-4: one row per column of ``df`` (name, position, SQL type, nullability).

    Built from the schema metadata only; its size is the column count.
    """
    rows = [(name, f.name, i + 1, sql_type_name(f.dataType), "YES" if f.nullable else "NO")
            for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, _COLUMNS_SCHEMA)


def schema_diff(columns_a: DataFrame, columns_b: DataFrame) -> DataFrame:
    """JOIN-1: columns of A whose name is not a column of B.

    The reference writes an uncorrelated ``NOT IN``; column names are never NULL,
    so a plain left anti join is equal to the null-aware form.
    """
    return (columns_a.join(columns_b.select("column_name"), "column_name", "left_anti")
            .select("column_name", "data_type").orderBy("column_name"))
