"""TOP-1..7: ranked lists with explicit NULL order and complete tie-breaks.

``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject``: every task keeps
its own k best rows and only k rows per task reach the final merge, so there
is no global sort of the input. Ties on the ranking key are broken by the
remaining output columns (R8) and NULLs sort first ascending, last descending
(R7), so the k rows are the same in every engine and every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.functions.measure_sets import BillingMeasures
from cargoscope.functions.predicates import due_soon, present
from cargoscope.functions.vocabulary import BILLING, BillingStates
from cargoscope.operators.threshold import top_groups


def sort_keys(df: DataFrame, keys: list[tuple[str, str]]) -> list[Column]:
    """Explicit keys first, then every other column of ``df`` ascending, as tie-breaks."""
    out, used = [], set()
    for name, direction in keys:
        c = F.col(f"`{name}`")
        out.append(c.desc_nulls_last() if direction == "desc" else c.asc_nulls_first())
        used.add(name)
    out += [F.col(f"`{n}`").asc_nulls_first() for n in df.columns if n not in used]
    return out


def top_k(df: DataFrame, keys: list[tuple[str, str]], k: int) -> DataFrame:
    if k < 1:
        raise ValueError("k must be >= 1")
    return df.orderBy(*sort_keys(df, keys)).limit(k)


def top_by_amount(df: DataFrame, group: list[str], k: int, keep: Column | None = None,
                  names: tuple[str, str] = ("viajes", "total"), amount: str = "tarifa_final",
                  where: Column | None = None) -> DataFrame:
    """Groups with the largest amount: aggregate first (partial + final), then top-k of the groups."""
    if where is not None:
        df = df.where(where)
    if keep is not None:
        df = df.where(keep)
    m = BillingMeasures(amount=amount)
    agg = df.groupBy(*group).agg(m.trips(names[0]), m.total(names[1]))
    return top_k(agg, [(names[1], "desc")], k)


def top_groups_by_amount(df: DataFrame, group: list[str], k: int, keep: Column | None = None,
                         names: tuple[str, str] = ("viajes", "total"), amount: str = "tarifa_final", **bounds) -> DataFrame:
    """:func:`top_by_amount` for keys that grow with the data: bounds tell which keys can reach the list, and only
    these are shuffled (``operators/threshold.py``). Finding them runs jobs when the list is built."""
    rows = df.where(keep) if keep is not None else df
    return top_groups(rows, group, amount, k, lambda part: top_by_amount(part, group, k, names=names, amount=amount), names[1], **bounds)


def top_companies(billing: DataFrame, k: int = 15) -> DataFrame:
    """TOP-1: companies with the largest amount."""
    return top_by_amount(billing, ["nombre_compania"], k, keep=present("nombre_compania"))


def pending_top(billing: DataFrame, k: int = 10, states: BillingStates = BILLING,
                where: Column | None = None) -> DataFrame:
    """TOP-2: (company, branch) with the largest unbilled amount (takes FLT-3/4)."""
    keep = F.col("estado_contable") == states.unbilled
    return top_by_amount(billing, ["nombre_compania", "nombre_sucursal"], k, keep=keep, where=where)


def view_pending_top(validated: DataFrame, k: int = 20, states: BillingStates = BILLING) -> DataFrame:
    """TOP-3: (company, branch, carrier) with the largest unbilled amount."""
    keep = F.col("estado_contable") == states.unbilled
    return top_by_amount(validated, ["nombre_compania", "nombre_sucursal", "transportista"], k, keep=keep,
                         names=("viajes", "total_pendiente"))


def pending_top_carrier(billing: DataFrame, k: int = 15, states: BillingStates = BILLING) -> DataFrame:
    """TOP-4: the same key on the billing fact, top 15."""
    keep = F.col("estado_contable") == states.unbilled
    return top_by_amount(billing, ["nombre_compania", "nombre_sucursal", "transportista"], k, keep=keep)


def pending_top_bounded(billing: DataFrame, k: int = 15, states: BillingStates = BILLING) -> DataFrame:
    """TOP-4 by thresholds, for tables with so many keys that shuffling them is what the list costs."""
    keep = F.col("estado_contable") == states.unbilled
    return top_groups_by_amount(billing, ["nombre_compania", "nombre_sucursal", "transportista"], k, keep=keep)


def top_branches(freight: DataFrame, k: int = 10) -> DataFrame:
    """TOP-5: branches with the largest amount."""
    return top_by_amount(freight, ["nombre_sucursal"], k, keep=present("nombre_sucursal"))


DUE_SOON_COLUMNS = ("referencia", "destino", "destino_carga", "cliente_final", "fecha_carga",
                    "compromiso_de_carga", "estado_viaje", "NS", "on_time")
TRIP_TABLE_COLUMNS = ("referencia", "origen", "destino", "zona", "cliente_final", "placa",
                      "compromiso_de_carga", "fecha_carga", "NS", "dias_retrazo",
                      "porcentaje_cumplimiento", "estado_viaje")


def trips_due_soon(trips: DataFrame, as_of: str | None = None, k: int = 8, horizon_days: int = 2,
                   where: Column | None = None) -> DataFrame:
    """TOP-6: the earliest commitments among off-time or due-soon trips (NULL commitment first)."""
    if where is not None:
        trips = trips.where(where)
    rows = trips.where(due_soon(as_of, horizon_days)).select(*DUE_SOON_COLUMNS)
    return top_k(rows, [("compromiso_de_carga", "asc")], k)


def trip_table(trips: DataFrame, k: int = 100, where: Column | None = None) -> DataFrame:
    """TOP-7: lowest compliance first, then reference descending."""
    if where is not None:
        trips = trips.where(where)
    rows = trips.select(*TRIP_TABLE_COLUMNS)
    return top_k(rows, [("porcentaje_cumplimiento", "asc"), ("referencia", "desc")], k)
