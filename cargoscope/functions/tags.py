"""DRV-4..7: bands and short tags the dashboards derive per row.

A NULL input falls through to the last branch, as the dashboard's comparisons
do (``null >= 100`` is false).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cargoscope.functions.vocabulary import BILLING, BillingStates


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Band tokens and thresholds.
BAND_HIGH, BAND_MID, BAND_LOW = "grn", "orn", "red"
BILLED_PCT_BANDS = (80, 50)        # DRV-4: >= 80 high, >= 50 mid, else low
COMPLIANCE_BANDS = (100, 90)       # DRV-5: >= 100 high, >= 90 mid, else low


def band(c: str | Column, high: float, mid: float) -> Column:
    x = _c(c)
    return F.when(x >= high, F.lit(BAND_HIGH)).when(x >= mid, F.lit(BAND_MID)).otherwise(F.lit(BAND_LOW))


def billed_pct_band(c: str | Column) -> Column:
    """DRV-4, shown only when the percentage exists (NULL stays NULL)."""
    return F.when(_c(c).isNotNull(), band(c, *BILLED_PCT_BANDS))


def compliance_band(c: str | Column) -> Column:
    """DRV-5: NULL average lands in the low band."""
    return band(c, *COMPLIANCE_BANDS)


def accounting_tag(c: str | Column = "estado_contable", s: BillingStates = BILLING) -> Column:
    """DRV-6: billed -> Fact, cancelled -> Anul, anything else (NULL included) -> Pend."""
    x = _c(c)
    return F.when(x == s.billed, F.lit("Fact")).when(x == s.cancelled, F.lit("Anul")).otherwise(F.lit("Pend"))


def flt_tag(c: str | Column = "estado_flt", s: BillingStates = BILLING) -> Column:
    """DRV-6: with FLT, otherwise the without-FLT label."""
    return F.when(_c(c) == s.with_flt, F.lit(s.with_flt)).otherwise(F.lit(s.without_flt))


def collection_tag(c: str | Column = "status_crisar", s: BillingStates = BILLING) -> Column:
    """DRV-6: collected -> cbr, any other non-blank status -> pen, none -> '-'."""
    x = _c(c)
    return (F.when(x.isNull() | (x == ""), F.lit("-"))
            .when(x == s.collected, F.lit("cbr"))
            .otherwise(F.lit("pen")))


def dispatch_tag(c: str | Column = "estado_envio_factura") -> Column:
    """DRV-7: dispatch state -> tag class."""
    x = _c(c)
    # Dispatch states and their tag classes.
    return (F.when(x == "ACEPTADO", F.lit("acp"))
            .when(x == "PENDIENTE", F.lit("pen"))
            .when(x == "Anulado", F.lit("anl"))
            .otherwise(F.lit("man")))
