"""PRJ-1/2/5 and PAG-1: detail projections, paging and the export ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.functions.predicates import present
from cargoscope.functions.scalars import day_text, fallback, month_key, or_default, short_label, year_text
from cargoscope.functions.tags import accounting_tag, collection_tag, dispatch_tag, flt_tag
from cargoscope.operators.paging import Cursor, folder_counts, folder_page_after, next_cursor, numbered_page, page_after


def fact_detail(billing: DataFrame, *more: str) -> DataFrame:
    """PRJ-1: the 14 columns of the billing detail table (and any others named)."""
    # The projected columns.
    return billing.select(
        "nombre_compania", "nombre_sucursal", "fecha_creacion",
        day_text("fecha_creacion").alias("fecha"),
        "titulo", "id_envio", "observacion", "tarifa_final", "n_flete",
        "estado_contable", "estado_conciliacion", "estado_flt", "status_crisar", "tipo_fact", *more,
    )


def page(df: DataFrame, keys: list[tuple[str, str]], page_no: int = 1, size: int = 50) -> DataFrame:
    """PAG-1: page ``page_no`` (1-based) of ``size`` rows in a complete, repeatable order."""
    return numbered_page(df, keys, page_no, size)


#: The order of the billing table's pages; ties go by every other column.
NEWEST_FIRST = (("fecha_creacion", "desc"),)
#: Folder column of the written billing table, in the order of NEWEST_FIRST.
MONTH_FOLDER = "mes_creacion"


def _paged(billing: DataFrame, where: Column | None) -> tuple[DataFrame, str | None]:
    """The detail rows with their month folder, if the table has one."""
    if where is not None:
        billing = billing.where(where)
    detail = fact_detail(billing)
    if MONTH_FOLDER not in billing.columns:
        return detail, None
    return fact_detail(billing, MONTH_FOLDER), MONTH_FOLDER


def fact_page(billing: DataFrame, page_no: int = 1, size: int = 50, where: Column | None = None, directory=None) -> DataFrame:
    """PAG-1 over PRJ-1: newest creation date first.

    Reads only the month folders that the page lies in; ``directory``, the ``month_directory`` of the same rows, saves
    counting them again.
    """
    rows, folder = _paged(billing, where)
    return numbered_page(rows, NEWEST_FIRST, page_no, size, folder, directory)


def month_directory(billing: DataFrame, where: Column | None = None) -> list[tuple[str | None, int]]:
    """Rows per creation month, newest first; from file metadata alone when there is no filter."""
    return folder_counts(billing if where is None else billing.where(where), MONTH_FOLDER)


def fact_page_after(billing: DataFrame, cursor: Cursor | None, size: int = 50, where: Column | None = None, directory=None) -> DataFrame:
    """PAG-1 by cursor over PRJ-1: the rows after ``cursor``, newest first; ``next_fact_cursor`` steps on from them."""
    rows, folder = _paged(billing, where)
    if folder is None:
        return page_after(rows, NEWEST_FIRST, cursor, size)
    created = cursor.values["fecha_creacion"] if cursor else None
    month = created.strftime("%Y-%m") if created else None
    return folder_page_after(rows, NEWEST_FIRST, cursor, size, folder, month, directory)


def next_fact_cursor(page_rows, billing: DataFrame, cursor: Cursor | None = None) -> Cursor | None:
    """The cursor after the collected rows of a page; None when there was none."""
    return next_cursor(page_rows, fact_detail(billing), NEWEST_FIRST, cursor)


def fact_pages(billing: DataFrame, pages: int, size: int = 50, where: Column | None = None, directory=None) -> DataFrame:
    """The first ``pages`` pages with their number (``pagina``), each found from the cursor of the one before."""
    if directory is None and MONTH_FOLDER in billing.columns:
        directory = month_directory(billing, where)
    cursor, out = None, None
    for number in range(1, pages + 1):
        rows = fact_page_after(billing, cursor, size, where, directory)
        numbered = rows.withColumn("pagina", F.lit(number))
        out = numbered if out is None else out.union(numbered)
        cursor = next_fact_cursor(rows.collect(), billing, cursor) if number < pages else None
        if cursor is None:
            break
    return out


def with_fact_tags(detail: DataFrame) -> DataFrame:
    """DRV-6: short tags of the detail table rows."""
    return detail.select(
        "*",
        accounting_tag("estado_contable").alias("tag_contable"),
        flt_tag("estado_flt").alias("tag_flt"),
        collection_tag("status_crisar").alias("tag_crisar"),
    )


def with_fact_labels(detail: DataFrame) -> DataFrame:
    """SCL-16/17: the table's cut names ('' if missing) and codes ('-' if missing)."""
    cut = {"nombre_compania": 14, "nombre_sucursal": 12, "titulo": 20, "observacion": 15}
    return detail.select(
        "*",
        *[short_label(or_default(c, ""), n).alias(f"{c}_corto") for c, n in cut.items()],
        *[or_default(c, "-").alias(f"{c}_texto") for c in ("id_envio", "n_flete")],
    )


def with_trip_labels(trips: DataFrame) -> DataFrame:
    """SCL-16/17: the trip table's cut client ('' if missing) and texts ('-' if missing)."""
    return trips.select(
        "*",
        short_label(or_default("cliente_final", ""), 25).alias("cliente_corto"),
        *[or_default(c, "-").alias(f"{c}_texto") for c in ("origen", "destino", "zona", "placa", "estado_viaje")],
    )


def with_destination(trips: DataFrame) -> DataFrame:
    """SCL-18: the loading destination, or else the trip's destination."""
    return trips.withColumn("destino_texto", fallback("destino_carga", "destino"))


def with_dispatch_tag(df: DataFrame) -> DataFrame:
    """DRV-7: tag class of the invoice dispatch state."""
    return df.withColumn("tag_envio", dispatch_tag("estado_envio_factura"))


# The exported columns and their names.
EXPORT_COLUMNS = (
    ("nombre_compania", "compania"), ("nombre_sucursal", "sucursal"), None,
    ("titulo", "titulo"), ("id_envio", "id_envio"), ("observacion", "observacion"),
    ("tarifa_final", "tarifa_final"), ("n_flete", "n_flete"), ("estado_contable", "estado_contable"),
    ("estado_conciliacion", "estado_conciliacion"), ("estado_flt", "estado_flt"),
    ("status_crisar", "status_crisar"), ("tipo_fact", "tipo_fact"), ("tipo_proceso", "tipo_proceso"),
    ("aprobacion", "aprobacion"), ("estado_envio_factura", "estado_envio_factura"),
)


def _skew_safe_order(date_col: str, tie_breaks: list[str]) -> list[Column]:
    """Newest first, then an id, then the row's position, as tie-breaks.

    The reference orders by the date alone and leaves ties unordered, so any
    tie order is correct. The extra keys matter for the distributed sort: the
    range partitioner cannot split equal keys, so one date holding a third of
    the rows would otherwise land in a single task. The id splits a hot date;
    the position (``monotonically_increasing_id``: input partition and offset,
    fixed for a given input) splits even a group of exact copies.
    """
    return [F.col(date_col).desc_nulls_last(), *[F.col(f"`{c}`").asc_nulls_first() for c in tie_breaks],
            F.monotonically_increasing_id().asc()]


def export_rows(billing: DataFrame, where: Column | None = None) -> DataFrame:
    """PRJ-2: the 16 export columns, newest first; the sort key itself is not projected."""
    if where is not None:
        billing = billing.where(where)
    cols = [day_text("fecha_creacion").alias("fecha") if spec is None else F.col(spec[0]).alias(spec[1])
            for spec in EXPORT_COLUMNS]
    return billing.orderBy(*_skew_safe_order("fecha_creacion", ["id_envio"])).select(*cols)


# The view's columns.
VIEW_DETAIL_COLUMNS = ("fecha", "nombre_compania", "nombre_sucursal", "titulo", "transportista", "tarifa_final",
                       "estado_flete", "estado_contable", "estado_envio_factura", "status_crisar", "tipo_fact",
                       "estado_conciliacion", "tipo_transporte", "n_flete", "nro_factura")


def view_detail_columns() -> list[Column]:
    return [*map(F.col, VIEW_DETAIL_COLUMNS), month_key("fecha").alias("mes"), year_text("fecha").alias("anio")]


def view_detail(validated: DataFrame) -> DataFrame:
    """PRJ-5: freight detail with month and year text, newest first."""
    return (validated.where(present("fecha")).select(*view_detail_columns())
            .orderBy(*_skew_safe_order("fecha", ["n_flete"])))
