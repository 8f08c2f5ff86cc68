"""WIN-1..3 and DRV-1..3: set-level shares and same-row derived measures.

These run on an already aggregated result (one row per category, company or
month), never on the fact table. Even so, no operator moves a whole result or
group into one task: a grand total is a scalar subquery (a partially
aggregated one-row result used as a constant), and per-group totals are a
group-by joined back on the group key, instead of a window whose partition
would have to sit in one task. Building a share runs no job and writes no file; where
the same aggregate is read twice, the planner reuses its exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoscope.functions import measures as M
from cargoscope.functions.tags import billed_pct_band, compliance_band


def _integral(df: DataFrame, c: str) -> Column:
    """The column as an integral number of its smallest unit (cents for money)."""
    dtype = df.schema[c].dataType
    if isinstance(dtype, T.DecimalType):
        return (F.col(c) * F.lit(10 ** dtype.scale)).cast("decimal(38,0)")
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return F.col(c).cast("decimal(38,0)")
    raise TypeError(f"{c} must be a decimal or integer column, got {dtype.simpleString()}")


def _with_whole(df: DataFrame, part: Column, agg, partition_by: list[str]) -> tuple[DataFrame, Column]:
    """``df`` plus the aggregate ``agg(part)`` over all rows, or over each ``partition_by`` group."""
    if not partition_by:
        return df, df.select(agg(part)).scalar()
    keys = [f"_key{i}" for i in range(len(partition_by))]
    wholes = df.groupBy(*[F.col(c).alias(k) for c, k in zip(partition_by, keys)]).agg(agg(part).alias("_whole"))
    cond = [df[c].eqNullSafe(wholes[k]) for c, k in zip(partition_by, keys)]
    joined = df.join(wholes, cond, "left").drop(*keys)
    return joined, F.col("_whole")


def share_of_total(df: DataFrame, value: str, name: str, partition_by: list[str] = (), dp: int = 1) -> DataFrame:
    """WIN-1: value / total (of its ``partition_by`` group) as a percentage; NULL when the total is 0."""
    v = _integral(df, value)
    out, whole = _with_whole(df, v, F.sum, list(partition_by))
    return out.withColumn(name, M.ratio_half_up(v * F.lit(100), whole, dp)).drop("_whole")


def share_of_max(df: DataFrame, value: str, name: str, partition_by: list[str] = (), dp: int = 0) -> DataFrame:
    """WIN-2: bar length, value / largest value (of its group) as a whole percentage."""
    v = _integral(df, value)
    out, whole = _with_whole(df, v, F.max, list(partition_by))
    return out.withColumn(name, M.ratio_half_up(v * F.lit(100), whole, dp)).drop("_whole")


def latest_month(trend: DataFrame, key: str = "mes", pct: str = "pct_fact") -> DataFrame:
    """WIN-3 + DRV-4: the latest month's row of a monthly trend, with the band of its billed share."""
    return trend.orderBy(F.col(key).desc_nulls_last()).limit(1).withColumn("banda", billed_pct_band(pct))


def billing_kpis_derived(kpis: DataFrame) -> DataFrame:
    """DRV-1: billed and collected share of the KPI totals, 0 when there is no total."""
    def pct(part: str) -> Column:
        e = M.ratio_sql(f"`{part}` * 10000", "`tarifa_total` * 100", 1)
        return F.expr(f"coalesce({e}, 0.0D)")

    return kpis.select("*", pct("facturado_total").alias("pct_fact_calc"), pct("cobrado_total").alias("pct_cob_calc"))


def company_stack(ranking: DataFrame) -> DataFrame:
    """DRV-2 + WIN-1: billed-but-not-collected per company and each company's share of all companies."""
    out = ranking.withColumn("facturado_no_cobrado", F.col("facturado") - F.col("cobrado"))
    return share_of_total(out, "total", "pct_total")


def receivables(summary: DataFrame) -> DataFrame:
    """DRV-3: amount still to collect and the remaining share (100 - collected share)."""
    remaining = F.lit(100).cast("decimal(5,1)") - F.coalesce(F.col("pct_cobrado"), F.lit(0.0)).cast("decimal(5,1)")
    return summary.select("*", (F.col("total_tarifa") - F.col("cob_total")).alias("por_cobrar"),
                          remaining.alias("pct_pendiente"))


def with_compliance_band(depts: DataFrame, avg: str = "cumpl", count: str = "cantidad") -> DataFrame:
    """DRV-5 + WIN-2: compliance band and bar length per department."""
    return share_of_max(depts.withColumn("banda", compliance_band(avg)), count, "barra_pct")
