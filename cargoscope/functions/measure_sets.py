"""Named measure builders over a billing-like frame.

Status codes and the amount column are constructor parameters, so one set of
operators serves the billing fact, the freight report and the validated table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cargoscope.functions import measures as M
from cargoscope.functions.vocabulary import BILLING, TRIPS, BillingStates, TripStates


class BillingMeasures:
    def __init__(self, states: BillingStates = BILLING, amount: str = "tarifa_final"):
        self.s = states
        self.amount = amount

    # predicates --------------------------------------------------------------
    def is_(self, column: str, value: str) -> Column:
        return F.col(column) == F.lit(value)

    @property
    def billed(self) -> Column:
        return self.is_("estado_contable", self.s.billed)

    @property
    def unbilled(self) -> Column:
        return self.is_("estado_contable", self.s.unbilled)

    @property
    def cancelled(self) -> Column:
        return self.is_("estado_contable", self.s.cancelled)

    @property
    def collected(self) -> Column:
        return self.is_("status_crisar", self.s.collected)

    # measures ----------------------------------------------------------------
    def trips(self, name: str) -> Column:
        return M.rows().alias(name)

    def total(self, name: str) -> Column:
        return M.amount_total(self.amount).alias(name)

    def avg(self, name: str) -> Column:
        return M.amount_avg(self.amount).alias(name)

    def min(self, name: str) -> Column:
        return M.amount_min(self.amount).alias(name)

    def max(self, name: str) -> Column:
        return M.amount_max(self.amount).alias(name)

    def count_if(self, pred: Column, name: str) -> Column:
        return M.count_where(pred).alias(name)

    def amount_if(self, pred: Column, name: str) -> Column:
        return M.amount_where(pred, self.amount).alias(name)

    def share_if(self, pred: Column, name: str) -> Column:
        return M.amount_share(M.amount_where(pred, self.amount), M.amount_total(self.amount)).alias(name)

    def state_block(self, pred: Column, n_name: str | None, amount_name: str | None,
                    pct_name: str | None = None) -> list[Column]:
        """Count, amount and share of the rows matching ``pred`` (any of them optional)."""
        out = []
        if n_name:
            out.append(self.count_if(pred, n_name))
        if amount_name:
            out.append(self.amount_if(pred, amount_name))
        if pct_name:
            out.append(self.share_if(pred, pct_name))
        return out


class TripMeasures:
    def __init__(self, states: TripStates = TRIPS):
        self.s = states

    def ns_is(self, value: str) -> Column:
        return F.col("NS") == F.lit(value)

    def compliance_avg(self, name: str) -> Column:
        """ROUND(AVG(porcentaje_cumplimiento), 1)."""
        return M.avg_half_up("porcentaje_cumplimiento", 1).alias(name)

    def delay_avg(self, name: str) -> Column:
        """ROUND(AVG(dias_retrazo), 1), fractions of days included."""
        return M.avg_half_up("dias_retrazo", 1).alias(name)
