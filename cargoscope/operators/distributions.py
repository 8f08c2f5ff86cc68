"""AGG-17..38: category distributions, one operator with an explicit blank policy.

``distribution`` is ``where(policy).groupBy(dim).agg(...)``: a hash aggregate
with map-side partial aggregation, so a category holding a third of the rows is
pre-aggregated in every task before the shuffle (one row per task per value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.functions import measures as M
from cargoscope.functions.measure_sets import BillingMeasures, TripMeasures
from cargoscope.functions.predicates import blank_policy


def distribution(df: DataFrame, dim: str, blanks: str, measures: list[Column], order_by: str,
                 limit: int | None = None, where: Column | None = None) -> DataFrame:
    """Measures per value of ``dim``, sorted by ``order_by`` descending.

    ``blanks`` is required: ``keep`` (NULL is a group), ``drop_null`` or
    ``drop_blank`` (NULL and '' dropped). Ties on ``order_by`` are broken by the
    category so a ``limit`` is deterministic (R8).
    """
    if where is not None:
        df = df.where(where)
    out = M.aggregate(df.where(blank_policy(dim, blanks)).groupBy(dim), *measures)
    out = out.orderBy(F.col(order_by).desc_nulls_last(), F.col(dim).asc_nulls_first())
    return out.limit(limit) if limit is not None else out


# --- presets: the distributions the dashboards and profiling scripts show ------

def count_by(df: DataFrame, dim: str, blanks: str, where: Column | None = None) -> DataFrame:
    """AGG-17..19, AGG-21: ``cantidad`` per value, count descending."""
    return distribution(df, dim, blanks, [M.rows().alias("cantidad")], "cantidad", where=where)


def amount_by(df: DataFrame, dim: str, blanks: str, with_avg: bool = False, where: Column | None = None,
              amount: str = "tarifa_final", names: tuple[str, str, str] = ("viajes", "total", "promedio")) -> DataFrame:
    """AGG-23..38: trips and amount (and optionally the average) per value, amount descending."""
    m = BillingMeasures(amount=amount)
    measures = [m.trips(names[0]), m.total(names[1])]
    if with_avg:
        measures.append(m.avg(names[2]))
    return distribution(df, dim, blanks, measures, names[1], where=where)


def compliance_by(trips: DataFrame, dim: str, blanks: str, avg_name: str, where: Column | None = None) -> DataFrame:
    """AGG-20, AGG-22: trips and average compliance per value, count descending."""
    t = TripMeasures()
    return distribution(trips, dim, blanks, [M.rows().alias("cantidad"), t.compliance_avg(avg_name)],
                        "cantidad", where=where)
