"""PAG-1: cursors and numbered pages whose cost doesn't grow with the page number.

The order of a page is complete: the given keys, then every other column ascending, so only exact copies are equal.

* A :class:`Cursor` is the whole last row and how many rows equal to it were shown. :func:`page_after` filters on it, so
  a step costs a first page however deep it is, and copies at a page's end are neither lost nor shown twice.
* :func:`numbered_page` finds page N without keeping the rows before it. A directory of rows per folder (a month, counted
  from file metadata when there is no filter) gives the folders the page lies in. Inside them, pivots narrow the place:
  a uniform sample of rows, a count of the rows before each, and again between the two pivots around the page, until few
  rows are left. Every step is one filtered scan with one row of counts; nothing is sorted or shuffled as a whole.

Only cursors, pivots (``PIVOTS`` rows) and counts reach the driver.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a numbered page may skip in its last step, whatever its number.
SKIPPED_ROWS = 8192
#: Pivots of a narrowing step.
PIVOTS = 16

Keys = Sequence[tuple[str, str]]


class Order:
    """A complete order of a frame's rows: given keys with direction, then the other columns ascending.

    Nulls sort last descending and first ascending.
    """

    def __init__(self, df: DataFrame, keys: Keys) -> None:
        self.descending = {name for name, direction in keys if direction == "desc"}
        given = [name for name, _ in keys]
        self.names = given + [c for c in df.columns if c not in set(given)]
        self.types = {f.name: f.dataType for f in df.schema.fields}

    def _literal(self, name: str, value) -> Column:
        """A value of the column's type. A wall-clock time stays one: a plain literal is read in the driver's zone."""
        kind = self.types[name]
        if isinstance(value, dt.datetime) and isinstance(kind, T.TimestampNTZType):
            value = value.isoformat(sep=" ")
        return F.lit(value).cast(kind)

    def columns(self) -> list[Column]:
        return [self._column(n).desc_nulls_last() if n in self.descending else self._column(n).asc_nulls_first() for n in self.names]

    @staticmethod
    def _column(name: str) -> Column:
        return F.col(f"`{name}`")

    def same(self, values: Mapping) -> Column:
        """The row equals ``values`` in every column they name."""
        return self._row(list(values)).eqNullSafe(self._literals(values, list(values)))

    def _row(self, names: list[str], of: Column | None = None) -> Column:
        """Columns of the row (or fields of a struct) as one struct: these compare field by field, nulls first."""
        return F.struct(*[(self._column(n) if of is None else of.getField(n)).alias(n) for n in names])

    def _literals(self, values: Mapping, names: list[str]) -> Column:
        return F.struct(*[self._literal(n, values[n]).alias(n) for n in names])

    def beyond(self, leading: list[str], of: Column) -> tuple[Column, Column]:
        """(the row sorts strictly after the struct ``of``, the row equals it) in the leading columns of the order."""
        found, equal, at = F.lit(False), F.lit(True), 0
        while at < len(leading):
            end = next((i for i in range(at, len(leading)) if leading[i] in self.descending), len(leading))
            names = leading[at:end] or [leading[at]]
            if end == at:
                value = of.getField(names[0])
                further = F.when(value.isNull(), False).otherwise(F.coalesce(self._column(names[0]) < value, F.lit(True)))
            else:
                further = self._row(names) > self._row(names, of)
            found = found | (equal & further)
            equal = equal & self._row(names).eqNullSafe(self._row(names, of))
            at += len(names)
        return found, equal

    def _beyond(self, values: Mapping) -> tuple[Column, Column]:
        leading = [n for n in self.names if n in values]
        if leading != self.names[: len(leading)] or len(leading) != len(values):
            raise ValueError("the values must name leading columns of the order")
        return self.beyond(leading, self._literals(values, leading))

    def after(self, values: Mapping, inclusive: bool = False) -> Column:
        """The row sorts strictly after ``values``, which name leading columns of the order (or equals them)."""
        found, equal = self._beyond(values)
        return self._first(values, True) & (found | equal if inclusive else found)

    def before(self, values: Mapping) -> Column:
        """The row sorts strictly before ``values``."""
        found, equal = self._beyond(values)
        return self._first(values, False) & ~(found | equal)

    def _first(self, values: Mapping, after: bool) -> Column:
        """What the first key alone says: a plain predicate that reaches the Parquet reader and bounds the scan."""
        name = self.names[0]
        if name not in values:
            return F.lit(True)
        c, value, descending = self._column(name), values[name], name in self.descending
        if value is None:
            # Nulls are last descending and first ascending.
            return c.isNull() if descending == after else F.lit(True)
        if descending == after:
            return (c <= self._literal(name, value)) | c.isNull()
        return c >= self._literal(name, value)

    def values(self, row: Row) -> dict:
        return {n: row[n] for n in self.names}


@dataclass(frozen=True)
class Cursor:
    """The last row shown (all columns of the order) and how many rows equal to it were shown so far."""

    values: Mapping
    equal_seen: int = 1

    def token(self) -> str:
        """The cursor as text, for a client to hand back."""
        body = {"equal": self.equal_seen, "row": [[name, *_packed(value)] for name, value in self.values.items()]}
        return base64.urlsafe_b64encode(json.dumps(body, ensure_ascii=False).encode()).decode()

    @staticmethod
    def of_token(token: str) -> Cursor:
        body = json.loads(base64.urlsafe_b64decode(token.encode()))
        equal = body["equal"]
        if not isinstance(equal, int) or equal < 0:
            raise ValueError("damaged cursor")
        return Cursor({name: _unpacked(kind, value) for name, kind, value in body["row"]}, equal)


_KINDS = {"datetime": dt.datetime.fromisoformat, "date": dt.date.fromisoformat, "decimal": Decimal, "plain": lambda v: v}


def _packed(value) -> tuple[str, object]:
    if isinstance(value, dt.datetime):
        return "datetime", value.isoformat()
    if isinstance(value, dt.date):
        return "date", value.isoformat()
    if isinstance(value, Decimal):
        return "decimal", str(value)
    if value is None or isinstance(value, (str, int, float, bool)):
        return "plain", value
    raise TypeError(f"a cursor can't hold a {type(value).__name__}")


def _unpacked(kind: str, value):
    return _KINDS[kind](value)


def checked(page_no: int, size: int) -> None:
    for name, value in (("page", page_no), ("page size", size)):
        if not isinstance(value, int) or isinstance(value, bool) or value < 1:
            raise ValueError(f"{name} must be an integer >= 1, got {value!r}")


def next_cursor(rows: Sequence[Row], df: DataFrame, keys: Keys, cursor: Cursor | None = None) -> Cursor | None:
    """Where to go on after a page's ``rows``, which followed ``cursor``; None after an empty page."""
    if not rows:
        return None
    order = Order(df, keys)
    last = order.values(rows[-1])
    equal = 0
    for row in reversed(rows):
        if order.values(row) != last:
            break
        equal += 1
    if equal == len(rows) and cursor is not None and dict(cursor.values) == last:
        equal += cursor.equal_seen
    return Cursor(last, equal)


def page_after(df: DataFrame, keys: Keys, cursor: Cursor | None, size: int = 50) -> DataFrame:
    """The ``size`` rows after ``cursor`` (None: the first page).

    One lazy plan in which each task keeps at most twice ``size`` rows. Only in the middle of more than ``size`` exact
    copies are the copies counted first, as they are all alike and needn't be skipped one by one.
    """
    checked(1, size)
    order = Order(df, keys)
    if cursor is None:
        return df.orderBy(*order.columns()).limit(size)
    seen = cursor.equal_seen
    if seen <= size:
        # Copies of the last row come first in what is left.
        ordered = df.where(order.after(cursor.values, inclusive=seen > 0)).orderBy(*order.columns())
        return (ordered.offset(seen) if seen else ordered).limit(size)
    copies = df.where(order.same(cursor.values)).count() - seen
    return _copies_then_rest(df, order, cursor.values, max(copies, 0), size)


def _copies_then_rest(df: DataFrame, order: Order, values: Mapping, copies: int, size: int) -> DataFrame:
    rest = df.where(order.after(values)).orderBy(*order.columns()).limit(max(size - copies, 0))
    if not copies:
        return rest
    return df.where(order.same(values)).limit(min(copies, size)).union(rest).orderBy(*order.columns())


def folder_counts(df: DataFrame, folder: str) -> list[tuple[str | None, int]]:
    """The directory: (folder value, rows), the newest folder first and the null folder last.

    Folder values are ``yyyy-MM`` texts, so there are at most 120,000 of them. Without a filter on other columns the
    counts come from file metadata.
    """
    counted = df.groupBy(folder).agg(F.count(F.lit(1)).alias("rows"))
    found = {row[folder]: row["rows"] for row in counted.collect()}
    return sorted(((m, n) for m, n in found.items() if m is not None), reverse=True) + ([(None, found[None])] if None in found else [])


def folders_of(directory: Sequence[tuple[str | None, int]], offset: int, size: int) -> tuple[list[str | None], int]:
    """The folders that hold rows ``offset`` to ``offset + size - 1``, and how many rows lie before them."""
    held, start, at = [], 0, 0
    for folder, rows in directory:
        if at + rows <= offset:
            start = at + rows
        elif at < offset + size:
            held.append(folder)
        at += rows
    return held, start


def folders_after(directory: Sequence[tuple[str | None, int]], folder: str | None, size: int) -> list[str | None]:
    """The folders that can hold the ``size`` rows after a row of ``folder``: that one, and as many older ones as hold
    ``size`` rows."""
    names = [f for f, _ in directory]
    at = names.index(folder) if folder in names else sum(f is not None and (folder is None or f > folder) for f in names)
    held, rows = [], 0
    for name, n in directory[at:]:
        held.append(name)
        rows += n if name != folder else 0
        if rows >= size:
            break
    return held


def in_folders(column: str, folders: Sequence[str | None]) -> Column:
    """The folder predicate; it prunes folders before any file is opened."""
    some = [f for f in folders if f is not None]
    found = F.col(column).isin(some) if some else F.lit(False)
    return found | F.col(column).isNull() if None in folders else found


def located(df: DataFrame, keys: Keys, offset: int, size: int, skipped: int = SKIPPED_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """Rows ``offset`` to ``offset + size - 1`` of ``df`` in order; no plan keeps more than ``skipped + 2 * size`` rows.

    ``low`` is the last known row before the page (with the number of rows up to it), ``high`` the first known row
    beyond the page's first place. Pivots between the two narrow them down; each step leaves out its pivots, so it ends.
    """
    order = Order(df, keys)
    low: dict | None = None
    high: dict | None = None
    passed = 0  # rows up to ``low``, copies of it included

    def rest() -> DataFrame:
        return df.where(order.after(low)) if low is not None else df

    while offset - passed > skipped:
        inside = rest().where(order.before(high)) if high is not None else rest()
        # Rows with the smallest hashes are a uniform sample of the distinct rows, the same one in every run.
        hashed = F.xxhash64(*[F.col(f"`{n}`") for n in order.names])
        sample = inside.orderBy(hashed, *order.columns()).limit(pivots).orderBy(*order.columns())
        chosen = [order.values(r) for r in dict.fromkeys(sample.collect())]
        if not chosen:  # the table ends before the page
            return rest().limit(0)
        counts, base = pivot_counts(inside, order, chosen), passed
        for values, (before, equal) in zip(chosen, counts, strict=True):
            if base + before > offset:
                high = values
                break
            if base + before + equal > offset:  # the page begins among the copies of this row
                return _copies_then_rest(df, order, values, base + before + equal - offset, size)
            low, passed = values, base + before + equal
    ordered = rest().orderBy(*order.columns())
    skip = offset - passed
    return (ordered.offset(skip) if skip else ordered).limit(size)


def pivot_counts(df: DataFrame, order: Order, chosen: Sequence[Mapping]) -> list[tuple[int, int]]:
    """Per pivot (in order) the rows of ``df`` strictly before it and those equal to it, by one scan.

    A row is dealt by the number of pivots it lies beyond and by whether it equals the next one, so at most two rows of
    counts a pivot come back.
    """
    pivots = F.array(*[order._literals(v, order.names) for v in chosen])
    beyond = F.size(F.filter(pivots, lambda p: order.beyond(order.names, p)[0]))
    equal = F.exists(pivots, lambda p: order.beyond(order.names, p)[1])
    dealt = {(r["beyond"], r["equal"]): r["rows"] for r in df.groupBy(beyond.alias("beyond"), equal.alias("equal")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    out, before = [], 0
    for i in range(len(chosen)):
        before += dealt.get((i, False), 0)
        out.append((before, same := dealt.get((i, True), 0)))
        before += same
    return out


def numbered_page(df: DataFrame, keys: Keys, page_no: int = 1, size: int = 50, folder: str | None = None,
                  directory: Sequence[tuple[str | None, int]] | None = None) -> DataFrame:
    """Page ``page_no`` (1-based) of ``size`` rows.

    ``folder`` names a column of folder values that orders as the first key does; it isn't part of the result. The
    directory picks the folders the page lies in, and pivots find the place inside them if more than ``SKIPPED_ROWS``
    rows come before it there. ``directory`` may be one that was counted before. Without folders the first pages are
    one lazy plan.
    """
    checked(page_no, size)
    offset = (page_no - 1) * size
    if folder is not None:
        folders, start = folders_of(directory if directory is not None else folder_counts(df, folder), offset, size)
        df, offset = df.where(in_folders(folder, folders)).drop(folder), offset - start
    return located(df, keys, offset, size)


def folder_page_after(df: DataFrame, keys: Keys, cursor: Cursor | None, size: int, folder: str, folder_of: str | None,
                      directory: Sequence[tuple[str | None, int]] | None = None) -> DataFrame:
    """:func:`page_after` that reads only the folders which can hold the page; ``folder_of`` is the cursor's folder."""
    checked(1, size)
    counted = directory if directory is not None else folder_counts(df, folder)
    folders = folders_of(counted, 0, size)[0] if cursor is None else folders_after(counted, folder_of, size)
    return page_after(df.where(in_folders(folder, folders)).drop(folder), keys, cursor, size)
