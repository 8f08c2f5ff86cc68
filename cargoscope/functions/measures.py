"""AGF-*: aggregate measures, with rounding that is exact and engine-independent.

Money is DECIMAL(18,2), so sums are exact and ``ROUND(SUM(x), 2)`` is the sum
itself. Averages and percentages are rounded half away from zero from the exact
integer ratio (rule R5): for integral ``n`` and ``d``

    round(n / d, k) = sign(n / d) * ((2 * |n| * 10^k + |d|) div (2 * |d|)) / 10^k

which never goes through a binary double before rounding. The DuckDB oracle
uses the same formula, so the two engines agree to the last bit.

Everything here is a built-in Column expression: partial aggregation happens
map-side and the plan stays inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
_WIDE_INT = "decimal(38,0)"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio_half_up(num: Column, den: Column, dp: int) -> Column:
    """``num / den`` rounded half away from zero at ``dp`` decimals, as DOUBLE.

    ``num`` and ``den`` must be integral. NULL when ``den`` is 0 or NULL (the
    SAFE_DIVIDE / NULLIF contract). The rounding itself is exact; only the final
    DOUBLE loses digits once the rounded value exceeds 2^53 units.
    """
    n = num.cast(_WIDE_INT)
    d = den.cast(_WIDE_INT)
    scale = 10 ** dp
    q = F.call_function("div", F.abs(n) * F.lit(2 * scale) + F.abs(d), F.abs(d) * F.lit(2))
    signed = F.when((n < 0) != (d < 0), -q).otherwise(q)
    return F.when(d != 0, signed.cast("double") / F.lit(float(scale)))


def ratio_sql(n: str, d: str, dp: int) -> str:
    """The same rounding as ``ratio_half_up`` as SQL text over two SQL operands."""
    s = 10 ** dp
    num = f"CAST({n} AS DECIMAL(38,0))"
    den = f"CAST({d} AS DECIMAL(38,0))"
    q = f"div(abs({num}) * {2 * s} + abs({den}), abs({den}) * 2)"
    return (f"CASE WHEN {den} <> 0 THEN CAST(CASE WHEN ({num} < 0) <> ({den} < 0) THEN -{q} ELSE {q} END "
            f"AS DOUBLE) / CAST({s} AS DOUBLE) END")


def ratio_of(num: str, den: str, dp: int, zero: bool = False) -> Column:
    """``ratio_sql`` over two existing columns, as one expression (used after an aggregation)."""
    e = ratio_sql(f"`{num}`", f"`{den}`", dp)
    return F.expr(f"coalesce({e}, 0.0D)" if zero else e)


@dataclass
class Ratio:
    """A measure computed from two aggregates after the aggregation.

    ``aggregate`` computes ``num`` and ``den`` as ordinary (partial + final)
    aggregates and then applies the exact rounding once per output row, as one
    expression over the two named results. This keeps the plan small: the
    aggregate sub-trees are not repeated inside the rounding formula.
    """

    num: Column
    den: Column
    dp: int
    zero: bool = False
    name: str = field(default="")

    def alias(self, name: str) -> "Ratio":
        return Ratio(self.num, self.den, self.dp, self.zero, name)


def split(measures: Sequence[Column | Ratio]) -> list[Column]:
    """The aggregates that ``measures`` are made from: a plain measure itself, both sides of a ratio."""
    out: list[Column] = []
    for i, m in enumerate(measures):
        if isinstance(m, Ratio):
            if not m.name:
                raise ValueError("a Ratio measure needs a name (use .alias)")
            out += [m.num.alias(f"__{i}_num"), m.den.alias(f"__{i}_den")]
        else:
            out.append(m)
    return out


def finished(parts: DataFrame, measures: Sequence[Column | Ratio]) -> DataFrame:
    """Keys and measures from rows that hold the keys and then the aggregates of ``split(measures)``."""
    width = sum(2 if isinstance(m, Ratio) else 1 for m in measures)
    at = len(parts.columns) - width
    cols = [F.col(f"`{c}`") for c in parts.columns[:at]]
    for m in measures:
        if isinstance(m, Ratio):
            cols.append(ratio_of(parts.columns[at], parts.columns[at + 1], m.dp, m.zero).alias(m.name))
            at += 2
        else:
            cols.append(F.col(f"`{parts.columns[at]}`"))
            at += 1
    return parts.select(*cols)


def aggregate(target: DataFrame | GroupedData, *measures: Column | Ratio) -> DataFrame:
    """``target.agg(*measures)`` where some measures may be ``Ratio`` specs.

    Output columns are the group keys followed by the measures in order.
    """
    return finished(target.agg(*split(measures)), measures)


def cents(amount_sum: Column) -> Column:
    """A scale-2 money value as an integral number of cents."""
    return (amount_sum * F.lit(100)).cast(_WIDE_INT)


def money(c: str | Column) -> Column:
    return _c(c).cast(MONEY)


# --- plain aggregates -------------------------------------------------------

def rows() -> Column:
    """AGF-1: COUNT(*)."""
    return F.count(F.lit(1))


def count_where(pred: Column) -> Column:
    """AGF-3: COUNTIF(p); rows where ``p`` is NULL are not counted (R2)."""
    return F.count_if(pred)


def distinct_count(c: str | Column) -> Column:
    """AGF-2: exact COUNT(DISTINCT c)."""
    return F.count_distinct(_c(c))


def amount_total(amount: str | Column) -> Column:
    """AGF-4: ROUND(SUM(x), 2) on a scale-2 decimal (exact, stays decimal)."""
    return F.sum(_c(amount))


def amount_where(pred: Column, amount: str | Column) -> Column:
    """AGF-5: SUM(IF(p, x, 0)): 0 for a group without a match, NULL on empty input (R3)."""
    return F.sum(F.when(pred, _c(amount)).otherwise(F.lit(0)))


def amount_avg(amount: str | Column) -> Ratio:
    """AGF-6: ROUND(AVG(x), 2) for money, exact half-up."""
    x = _c(amount)
    return Ratio(cents(F.sum(x)), F.count(x) * F.lit(100), 2)


def avg_half_up(c: str | Column, dp: int, input_scale: int = 6, zero: bool = False) -> Ratio:
    """AGF-6 for measurements: ROUND(AVG(x), dp) on values normalised to ``input_scale`` decimals."""
    x = _c(c)
    if input_scale == 0:
        total = F.sum(x.cast("long"))
    else:
        total = (F.sum(x.cast(f"decimal(18,{input_scale})")) * F.lit(10 ** input_scale)).cast(_WIDE_INT)
    return Ratio(total, F.count(x) * F.lit(10 ** input_scale), dp, zero)


def amount_share(part_sum: Column, whole_sum: Column, dp: int = 1) -> Ratio:
    """AGF-8/9: ROUND(SAFE_DIVIDE(part, whole) * 100, dp) on money sums; NULL on a zero total."""
    return Ratio(cents(part_sum) * F.lit(100), cents(whole_sum), dp)


def count_share_of(part: str, whole: str, dp: int = 1, zero: bool = False) -> Column:
    """ROUND(SAFE_DIVIDE(part, whole) * 100, dp) over two existing count columns, as one expression."""
    e = ratio_sql(f"`{part}` * 100", f"`{whole}`", dp)
    return F.expr(f"coalesce({e}, 0.0D)" if zero else e)


def or_zero(c: Column) -> Column:
    """AGF-10: the Python/JS fallback of a share or average: NULL becomes 0."""
    return F.coalesce(c, F.lit(0.0))


def amount_min(amount: str | Column) -> Column:
    return F.min(_c(amount))


def amount_max(amount: str | Column) -> Column:
    return F.max(_c(amount))
