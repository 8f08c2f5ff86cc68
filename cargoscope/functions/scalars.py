"""SCL-*: scalar formats and label helpers (all built-in expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_key(c: str | Column) -> Column:
    """SCL-1: ``yyyy-MM`` month key (session time zone is UTC)."""
    return F.date_format(_c(c), "yyyy-MM")


def day_text(c: str | Column) -> Column:
    """SCL-2: ``dd-MM-yyyy``."""
    return F.date_format(_c(c), "dd-MM-yyyy")


def year_text(c: str | Column) -> Column:
    """SCL-3: ``yyyy``."""
    return F.date_format(_c(c), "yyyy")


def month_start(c: str | Column) -> Column:
    """SCL-4: first instant of the month, kept as TIMESTAMP_NTZ (date_trunc widens it)."""
    return F.date_trunc("month", _c(c)).cast("timestamp_ntz")


def short_label(c: str | Column, n: int) -> Column:
    """SCL-16: the first ``n`` characters (1-based substring)."""
    return F.substring(_c(c), 1, n)


def or_default(c: str | Column, default: str = "N/A") -> Column:
    """SCL-17: NULL and '' both count as missing."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(default))


def fallback(primary: str | Column, secondary: str | Column) -> Column:
    """SCL-18: ``primary`` unless it is NULL or '', else ``secondary``."""
    return F.coalesce(F.nullif(_c(primary), F.lit("")), _c(secondary))


ISO_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss"
ISO_DATE = "yyyy-MM-dd"


def to_edge(df: DataFrame) -> DataFrame:
    """SNK-1 edge form: money as DOUBLE, dates and timestamps as ISO-8601 text.

    Operators keep exact decimals and native datetimes; this runs last, on the
    (usually small) result, right before it leaves Spark.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, ISO_TIMESTAMP)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, ISO_DATE)
        cols.append(c.alias(f.name))
    return df.select(*cols)
