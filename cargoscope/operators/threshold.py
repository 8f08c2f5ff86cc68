"""TOP-2..4 for keys that grow with the data: the k groups with the largest sum, without shuffling every group's key.

A plain top-k of sums shuffles each distinct key with its columns. Here each row is dealt to a cell by a hash of its key,
and one scan sums the positive amounts per cell: no key of a cell can have a larger total. The cells with the largest
bounds are then summed exactly, key by key. If the k-th total among them is above the largest bound of every other cell,
no other key can reach the list; otherwise more cells are taken, and beyond ``MOST_CELLS`` of them all groups are summed.
So the first shuffle carries a hash and a sum instead of the key's columns, and the second one only the keys of the
chosen cells. The result is always that of summing every group.

Defined results: null amounts add nothing; a group whose total is null comes last; groups with equal totals are ordered
by the other output columns; null key columns are values like others; an empty table gives an empty list. Amounts must
be integers or decimals, whose sums don't depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells that are summed exactly at first, their growth a step, and the most of them. Only this many hashes and bounds
#: reach the driver.
FIRST_CELLS, GROWTH, MOST_CELLS = 512, 8, 4096


def top_groups(df: DataFrame, group: Sequence[str], amount: str, k: int, finish: Callable[[DataFrame], DataFrame], total: str,
               first: int = FIRST_CELLS, most: int = MOST_CELLS, cells: int | None = None) -> DataFrame:
    """The ``k`` groups with the largest sum of ``amount``.

    ``finish`` aggregates the rows it is given by ``group`` and returns the top ``k`` in order; ``total`` names its
    column of totals. ``cells`` bounds the number of cells, which bounds the first shuffle too (a cell may then hold
    several keys and its bound is looser); by default each key has its own, but for equal hashes.
    """
    if k < 1 or not 1 <= first <= most:
        raise ValueError("k and the numbers of cells must be >= 1")
    kind = df.schema[amount].dataType
    if not isinstance(kind, (T.DecimalType, T.IntegralType)):
        raise ValueError(f"sums of {kind.simpleString()} depend on their order; cast {amount!r} to a decimal")
    taken = first
    bounds = cell_bounds(df, group, amount, most + 1, cells)
    while taken < len(bounds):
        inside = finish(df.where(cell(group, cells).isin([c for c, _ in bounds[:taken]])))
        kth = inside.select(total).collect()[k - 1:k]  # k rows: the list itself
        if kth and kth[0][0] is not None and kth[0][0] > bounds[taken][1]:
            return inside
        if taken == most:
            return finish(df)
        taken = min(taken * GROWTH, most)
    # There are no more cells than these: every key lies in one.
    return finish(df)


def cell(group: Sequence[str], cells: int | None = None) -> Column:
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in group])
    return hashed if cells is None else F.pmod(hashed, F.lit(cells))


def cell_bounds(df: DataFrame, group: Sequence[str], amount: str, n: int, cells: int | None = None) -> list[tuple[int, object]]:
    """The ``n`` cells with the largest sums of positive amounts, largest first: (cell, sum)."""
    given = F.col(f"`{amount}`")
    positive = F.sum(F.when(given > 0, given).otherwise(F.lit(0).cast(df.schema[amount].dataType)))
    summed = df.groupBy(cell(group, cells).alias("cell")).agg(positive.alias("bound"))
    return [(r["cell"], r["bound"]) for r in summed.orderBy(F.col("bound").desc(), "cell").limit(n).collect()]
