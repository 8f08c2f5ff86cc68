"""BKT-1: delay buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.functions import measures as M

# Bucket labels, in the order of their bounds.
ON_TIME_LABEL = "A tiempo"
BUCKETS = ((1, 3, "1-3 días"), (4, 7, "4-7 días"))
OVERFLOW_LABEL = "+7 días"


def delay_bucket(days: str | Column = "dias_retrazo") -> Column:
    """NULL or <= 0 -> on time; closed ranges next; everything else overflows.

    As written, a fractional delay in (0,1), (3,4) or (7,8) falls through to the
    overflow bucket (R9).
    """
    d = F.col(days) if isinstance(days, str) else days
    out = F.when(d.isNull() | (d <= 0), F.lit(ON_TIME_LABEL))
    for lo, hi, label in BUCKETS:
        out = out.when(d.between(lo, hi), F.lit(label))
    return out.otherwise(F.lit(OVERFLOW_LABEL))


def delay_buckets(trips: DataFrame, days: str = "dias_retrazo", where: Column | None = None) -> DataFrame:
    """Count per bucket, ordered by the smallest delay in it (NULL as 0) — a key not in the output (R10)."""
    if where is not None:
        trips = trips.where(where)
    d = F.col(days)
    out = trips.groupBy(delay_bucket(d).alias("rango")).agg(
        M.rows().alias("cantidad"), F.min(F.coalesce(d, F.lit(0))).alias("_order"))
    return out.orderBy("_order", "rango").drop("_order")
