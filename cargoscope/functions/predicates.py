"""FLT-*: predicates returned as Columns, so Catalyst can push them into the scan.

Every optional filter follows the same rule: an empty argument means "no
filter", given arguments are AND-ed, and values are bound as literals (never
spliced into SQL text).
"""

from __future__ import annotations

import re
from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cargoscope.functions.vocabulary import TRIPS, TripStates

BLANK_POLICIES = ("keep", "drop_null", "drop_blank")


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: str | Column) -> Column:
    """FLT-5: not NULL (an empty string is kept)."""
    return _c(c).isNotNull()


def not_blank(c: str | Column) -> Column:
    """FLT-6: not NULL and not ''."""
    return _c(c).isNotNull() & (_c(c) != F.lit(""))


def has_value(c: str | Column, sentinels: tuple[str, ...] = TRIPS.plate_sentinels) -> Column:
    """FLT-7: not NULL and not one of the sentinel strings (a single space is a value)."""
    return _c(c).isNotNull() & ~_c(c).isin(*sentinels)


def blank_policy(c: str | Column, blanks: str) -> Column:
    """R1: the three coexisting missing-value policies; there is no default."""
    if blanks == "keep":
        return F.lit(True)
    if blanks == "drop_null":
        return present(c)
    if blanks == "drop_blank":
        return not_blank(c)
    raise ValueError(f"blanks must be one of {BLANK_POLICIES}, got {blanks!r}")


def all_of(*preds: Column) -> Column:
    """R12: AND of all clauses; no clause at all is TRUE."""
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def equals_if_given(pairs: list[tuple[str, str | None]]) -> Column:
    """FLT-12: ``column = value`` for every pair whose value is non-empty."""
    return all_of(*[F.col(c) == F.lit(v) for c, v in pairs if v])


# Request argument -> trip column, and the NS code mapping.
TRIP_FILTER_COLUMNS = {"planta": "origen_carga", "destino": "destino_carga", "zona": "zona"}


def trip_filter(planta: str = "", destino: str = "", zona: str = "", ns: str = "",
                states: TripStates = TRIPS) -> Column:
    """FLT-1/FLT-2: optional trip filters. An unknown ``ns`` code is ignored."""
    pairs = [(TRIP_FILTER_COLUMNS["planta"], planta), (TRIP_FILTER_COLUMNS["destino"], destino),
             (TRIP_FILTER_COLUMNS["zona"], zona)]
    ns_value = {"ON_TIME": states.on_time, "OFF_TIME": states.off_time}.get(ns)
    pairs.append(("NS", ns_value))
    return equals_if_given(pairs)


# Request argument -> billing column (eleven optional equality filters).
FACT_FILTER_COLUMNS = {
    "compania": "nombre_compania",
    "estado_contable": "estado_contable",
    "estado_flete": "estado_flete",
    "estado_flt": "estado_flt",
    "estado_conciliacion": "estado_conciliacion",
    "status_crisar": "status_crisar",
    "tipo_fact": "tipo_fact",
    "status_cont_aje": "status_contabilidad_aje",
    "aprobacion": "aprobacion",
    "tipo_proceso": "tipo_proceso",
    "estado_envio_factura": "estado_envio_factura",
}

_MONTH = re.compile(r"^(\d{4})-(\d{2})$")


def _month_start(month: str) -> date:
    m = _MONTH.match(month)
    if not m or not 1 <= int(m.group(2)) <= 12:
        raise ValueError(f"month must be 'YYYY-MM', got {month!r}")
    return date(int(m.group(1)), int(m.group(2)), 1)


def _next_month(d: date) -> date:
    return date(d.year + d.month // 12, d.month % 12 + 1, 1)


def _ts_literal(d: date) -> Column:
    return F.lit(d.isoformat()).cast("timestamp_ntz")


def month_range(c: str | Column, mes_desde: str = "", mes_hasta: str = "") -> Column:
    """FLT-4: inclusive month range as half-open bounds on the raw column.

    ``>= first day of mes_desde`` and ``< first day of the month after mes_hasta``.
    The column itself is compared (never its formatted month), so both bounds
    reach the Parquet scan as pushed filters.
    """
    preds = []
    if mes_desde:
        preds.append(_c(c) >= _ts_literal(_month_start(mes_desde)))
    if mes_hasta:
        preds.append(_c(c) < _ts_literal(_next_month(_month_start(mes_hasta))))
    return all_of(*preds)


def month_folders(month_col: str, mes_desde: str = "", mes_hasta: str = "") -> Column:
    """The same month range on a ``yyyy-MM`` folder-partition column, so whole folders are pruned.

    Equivalent to ``month_range`` on the date the column is derived from (both
    drop NULL dates); it is added next to it, never instead of it.
    """
    preds = []
    if mes_desde:
        preds.append(F.col(month_col) >= F.lit(_month_start(mes_desde).strftime("%Y-%m")))
    if mes_hasta:
        preds.append(F.col(month_col) <= F.lit(_month_start(mes_hasta).strftime("%Y-%m")))
    return all_of(*preds)


def fact_filter(mes_desde: str = "", mes_hasta: str = "", date_col: str = "fecha_creacion",
                month_col: str | None = None, **args: str) -> Column:
    """FLT-3 + FLT-4: the billing panel filter. Unknown argument names are an error.

    ``month_col`` names the table's ``yyyy-MM`` folder-partition column of
    ``date_col``, if it has one; the month range is then also applied to it for
    partition pruning.
    """
    unknown = set(args) - set(FACT_FILTER_COLUMNS)
    if unknown:
        raise TypeError(f"unknown billing filter(s): {sorted(unknown)}")
    pairs = [(col, args.get(arg, "")) for arg, col in FACT_FILTER_COLUMNS.items()]
    out = equals_if_given(pairs) & month_range(date_col, mes_desde, mes_hasta)
    if month_col:
        out = out & month_folders(month_col, mes_desde, mes_hasta)
    return out


def due_soon(as_of: str | date | None = None, horizon_days: int = 2, ns_col: str = "NS",
             commit_col: str = "compromiso_de_carga", states: TripStates = TRIPS) -> Column:
    """FLT-10: off-time, or committed on or before ``as_of + horizon_days``.

    ``as_of`` replaces the wall-clock current date so results are repeatable;
    ``None`` means ``current_date()`` (SCL-7).
    """
    today = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
    limit = F.date_add(today, horizon_days)
    return (F.col(ns_col) == F.lit(states.off_time)) | (F.col(commit_col).isNotNull() & (F.col(commit_col) <= limit))
