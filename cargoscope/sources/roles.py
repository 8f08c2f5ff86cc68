"""Role frames: the reporting tables the operators run on, derived from the star schema.

The operators are written against a billing fact, a pending-trips table, an
on-time report, an orders table and a dispatch table. The driver's data is a
TPC-H-like star schema, so each role frame is a join of lineitem (or orders)
with its dimensions plus a column mapping that deliberately creates NULLs,
blanks and sentinels (FIXTURES.md section 2 documents every expression; the
DuckDB oracle in plans/oracle.py repeats them).

Scale notes
-----------
* Joins are written fact-last: orders is joined to customer/nation first (order
  grain), then lineitem joins that once on the order key with a sort-merge join
  (both sides grow with the data, so neither is ever broadcast). That join is
  written once (LINE_ORDERS); billing and trips read it and add supplier, part
  and region. All dimensions are left to the planner,
  whose size threshold falls back to a sort-merge join, and AQE splits skewed
  join partitions (a hot customer or supplier) at run time.
* The lineitem-grain roles are written once as Parquet below the cluster's
  ``spark.checkpoint.dir`` and read back, so every dashboard panel scans a
  column-pruned table instead of repeating four shuffle joins, and lineage is
  cut at a durable table (survives executor loss). The billing table is laid
  out for month-range filters (see MATERIALISED): range-partitioned on the
  creation date with a tie-break, clustered inside each file by the columns that
  its filters use, and written in one folder per creation month. Without a configured checkpoint folder the
  call is an error, unless the lazy joins are asked for.
"""

from __future__ import annotations

import hashlib
import os
import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cargoscope.functions.predicates import FACT_FILTER_COLUMNS, TRIP_FILTER_COLUMNS
from cargoscope.functions.scalars import month_key
from cargoscope.session import checkpoint_dir
from cargoscope.sinks.layout import write_skippable
from cargoscope.sources.metadata import row_session
from cargoscope.sources.snapshots import MOST_PARTS, Commits, Snapshot, added_files
from cargoscope.sources.tables import table

ROLE_NAMES = ("billing", "trips", "on_time", "orders", "dispatch")
# The freight report and the validated-freight table share the billing mapping.
ROLE_ALIASES = {"freight": "billing", "validated": "billing"}
# Physical layout of the written roles: (range-partition keys, in-file clustering keys, folder partition column).
# billing is range-partitioned on its creation date (the line's key and then the row's position break ties, so a
# hot date, or even a group of exact copies, still spreads over many tasks) and written in one folder per
# creation month, so a month-range filter prunes folders and skips files by their dates. Inside a file, rows
# are clustered by the company and ledger filters, so these skip row groups and pages. POSITION is the line's place in its source file, taken
# from the scan: a task that runs again after a lost executor gives each row the same key, so no row changes
# partition between attempts. A number given after the joins would depend on the order of fetched blocks.
POSITION = "__position__"
# The line's number, its position's bits and its classes in one number, which sorts in this order: see billing_rows.
PLACE = "__place__"
# trips keeps its join partitioning and is clustered inside each file by the columns its equality filters
# use most (plant, then zone).
LINE_ORDERS = "line_orders"
MATERIALISED = {
    LINE_ORDERS: ((), (), None),
    "billing": (("fecha_creacion", "l_orderkey", PLACE), ("nombre_compania", "estado_contable", "fecha_creacion"), "mes_creacion"),
    "trips": ((), ("origen_carga", "zona"), None),
    "dispatch": ((), (), None),
}
# Columns of the optional equality filters (FLT-1, FLT-3): they get Bloom filters.
LOOKUP = {
    "billing": tuple(FACT_FILTER_COLUMNS.values()),
    "trips": (*TRIP_FILTER_COLUMNS.values(), "NS"),
}
# Folder partition column of the billing role ('yyyy-MM' of the creation date).
BILLING_MONTH_PARTITION = "mes_creacion"

def _nation(t: dict[str, DataFrame], prefix: str) -> DataFrame:
    n = t["nation"]
    return (
        n.select(
            F.col("n_nationkey").alias(f"{prefix}_nationkey"),
            F.col("n_name").alias(f"{prefix}_nation"),
            F.col("n_regionkey").alias(f"{prefix}_regionkey"),
        )
    )


#: Columns of the joined lines that the mappings use.
LINE_ORDER_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority",
    "c_custkey", "c_name", "c_mktsegment", "cn_nation", "cn_regionkey",
)


def _orders_with_customer(t: dict[str, DataFrame]) -> DataFrame:
    """Order grain: orders joined to its customer and the customer's nation."""
    o = t["orders"]
    c = t["customer"].select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    out = o.join(c, o["o_custkey"] == c["c_custkey"]).join(
        _nation(t, "cn"), F.col("c_nationkey") == F.col("cn_nationkey")
    )
    return out


def _join_lines_to_orders(t: dict[str, DataFrame], orders: DataFrame) -> DataFrame:
    """lineitem joined to its order with a sort-merge join, never a broadcast.

    Both sides grow with the data, so neither may be broadcast on the strength
    of a static size estimate (after column pruning a small lineitem can look
    small enough to broadcast, which would stream the whole join from the
    orders scan). The join shuffles both sides on the order key; an order has at
    most seven lines, and if copies of one line ever make a key hot, AQE's skew
    join splits that partition of the lineitem side.
    """
    li = t["lineitem"]
    return li.join(orders.hint("merge"), li["l_orderkey"] == F.col("o_orderkey"))


#: Text columns of lineitem that may have few values, and the most that they may have to be shuffled as seven bits.
CODED_FLAGS = ("l_returnflag", "l_linestatus")
MOST_FLAGS = 127


def flag_lists(t: dict[str, DataFrame]) -> dict[str, list[str]]:
    """The values of the columns of CODED_FLAGS that have few."""
    return few_values(t["lineitem"], {c: c for c in CODED_FLAGS}, MOST_FLAGS)


def build_line_orders(t: dict[str, DataFrame], lists: dict[str, list[str]] | None = None) -> DataFrame:
    """The lines with their order, customer and nation: what billing and trips have in common.

    With ``lists`` (see :func:`flag_lists`) the line's number, short position and flags go through the join's shuffle as
    one number.
    """
    place = [POSITION] if POSITION in t["lineitem"].columns else []
    if lists is not None:
        flags = {c: 7 * i for i, c in enumerate(CODED_FLAGS) if c in lists}
        held = [c for c in LINE_ORDER_COLUMNS if c.startswith("l_") and c != "l_linenumber" and c not in flags]
        low = _coded(lists, flags) + (F.shiftleft(F.col(POSITION).cast("long"), 14) if place else F.lit(0).cast("long"))
        t = t | {"lineitem": t["lineitem"].select(*held, (_number_or_null("l_linenumber", 31) + low).alias(PLACE))}
    x = _join_lines_to_orders(t, _orders_with_customer(t))
    if lists is not None:
        x = x.withColumns({"l_linenumber": _number_back(31), **_decoded(lists, flags, PLACE, 127)})
        x = x.withColumns({POSITION: F.shiftright(F.col(PLACE), 14).bitwiseAND(F.lit(0xFFFF)).cast("int")} if place else {})
    return x.select(*LINE_ORDER_COLUMNS, *place)


def _lines(t: dict[str, DataFrame]) -> DataFrame:
    """The written join where there is one, else its plan."""
    return t[LINE_ORDERS] if LINE_ORDERS in t else build_line_orders(t)


def _on_time_label(late_days: Column) -> Column:
    return F.when(late_days.isNull() | (late_days <= 0), F.lit("ON TIME")).otherwise(F.lit("OFF TIME"))


def _trip_state(in_time: Column) -> Column:
    return F.when(in_time, F.lit("Llegó a tiempo")).otherwise(F.lit("Tarde"))


#: Columns of which the mapping needs a class alone: they travel as two bits each of one number, at these places.
CLASSES = "__classes__"
ARRIVAL, FLT, QUANTITY, STATUS, SIZE = 0, 2, 4, 6, 8


def _class(place: int, *when: Column) -> Column:
    """The number of the first condition that holds, or that of all of them, at ``place``."""
    found = F.lit(len(when))
    for number in reversed(range(len(when))):
        found = F.when(when[number], F.lit(number)).otherwise(found)
    return F.shiftleft(found, place)


def _is_class(place: int, number: int) -> Column:
    return F.shiftright(F.col(CLASSES), place).bitwiseAND(F.lit(3)) == number


#: Text columns of billing that may have few values; those that do go through the shuffles as a byte each of one number,
#: by their number in a list of the values that the build finds.
CODES = "__codes__"
CODED_LINES = {"nombre_compania": "cn_nation", "l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus",
               "o_orderpriority": "o_orderpriority", "c_mktsegment": "c_mktsegment"}
CODED_PARTS = ("p_name", "p_brand", "p_type")
CODED = {name: 8 * i for i, name in enumerate((*CODED_LINES, *CODED_PARTS))}
#: Most values of a coded column (number 0 stands for null), and their greatest length.
MOST_CODES, MOST_CODED_LENGTH = 255, 200


def few_values(frame: DataFrame, columns: dict[str, str], most: int) -> dict[str, list[str]]:
    """The values of each column (name -> column) that has at most ``most`` of them, none of them long; the others aren't
    in it. Only such lists reach the driver."""
    seen = frame.agg(*[F.approx_count_distinct(c).alias(f"n_{name}") for name, c in columns.items()],
                     *[F.max(F.length(c)).alias(f"l_{name}") for name, c in columns.items()]).first()
    few = {name: c for name, c in columns.items() if seen[f"n_{name}"] <= most and (seen[f"l_{name}"] or 0) <= MOST_CODED_LENGTH}
    if not few:
        return {}
    lists = frame.agg(*[F.collect_set(c).alias(name) for name, c in few.items()]).first()
    return {name: sorted(lists[name]) for name in few if len(lists[name]) <= most}


def value_lists(t: dict[str, DataFrame]) -> dict[str, list[str]]:
    """The values of the columns of CODED that have few."""
    return few_values(_lines(t), CODED_LINES, MOST_CODES) | few_values(t["part"], {c: c for c in CODED_PARTS}, MOST_CODES)


def _coded(lists: dict[str, list[str]], places: dict[str, int]) -> Column:
    """The numbers of the columns that have a list, each at its place; 0 stands for null."""
    made = F.lit(0).cast("long")
    for name, place in places.items():
        if name in lists:
            at = F.array_position(F.lit(lists[name]), F.col(name))
            unknown = F.raise_error(F.concat(F.lit(f"a value of {name} came up during the build: "), F.col(name))).cast("long")
            made = made.bitwiseOR(F.shiftleft(F.coalesce(F.when(at > 0, at).when(F.col(name).isNotNull(), unknown), F.lit(0).cast("long")), place))
    return made


def _decoded(lists: dict[str, list[str]], places: dict[str, int], number: str, mask: int) -> dict[str, Column]:
    """The columns that :func:`_coded` made numbers of."""
    return {c: F.get(F.lit(lists[c]), F.shiftright(F.col(number), p).bitwiseAND(F.lit(mask)).cast("int") - 1) for c, p in places.items() if c in lists}


def _number_or_null(column: str, place: int) -> Column:
    """An int at ``place``; the bit below it is set for null."""
    return F.coalesce(F.shiftleft(F.col(column).cast("int").cast("long"), place), F.lit(1 << (place - 1)).cast("long"))


def _number_back(place: int) -> Column:
    return F.when(F.shiftright(F.col(PLACE), place - 1).bitwiseAND(F.lit(1)) == 0, F.shiftright(F.col(PLACE), place).cast("int"))


def billing_rows(t: dict[str, DataFrame], lists: dict[str, list[str]] | None = None) -> DataFrame:
    """The joined lines of billing with what their mapping needs, each value once: this is what the write shuffles.

    Lines are cut down before the join with part, which shuffles them once part is too large for a broadcast; the
    supplier's name is added after it. Values that the mapping only compares go as classes. With ``lists`` (see
    :func:`value_lists`) the columns in it go as CODES, and the line's number, short position and classes as PLACE, which
    :func:`billing_keys` and :func:`billing_columns` take apart: a shuffled row's size is mostly its number of columns.
    """
    s = t["supplier"].select("s_suppkey", "s_name")
    p = t["part"].select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    lines = _lines(t)
    place = [POSITION] if POSITION in lines.columns else []
    col = F.col
    lines = lines.select(
        F.when(col("l_suppkey") % 50 != 7, col("o_orderdate")).alias("fecha_creacion"),
        F.when(col("l_partkey") % 97 != 0, col("l_extendedprice").cast("decimal(18,2)")).alias("tarifa_final"),
        F.when(col("c_custkey") % 40 != 0, col("cn_nation")).alias("nombre_compania"),
        (
            _class(ARRIVAL, col("l_shipdate") <= col("o_orderdate"))
            + _class(FLT, col("l_suppkey") % 25 == 3)
            + _class(QUANTITY, col("l_quantity") <= 20, col("l_quantity") <= 40, col("l_quantity") < 50)
            + _class(STATUS, *[col("o_orderstatus") == s for s in "FOP"])
        ).alias(CLASSES),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate",
        "o_orderpriority", "c_name", "c_mktsegment", *place,
    )
    sizes = _class(SIZE, col("p_size") <= 10, col("p_size") <= 30)
    numbers = [(col(CLASSES) + sizes).alias(CLASSES)]
    if lists is not None:
        low = col(CLASSES).cast("long") + (F.shiftleft(col(POSITION).cast("long"), 10) if place else F.lit(0).cast("long"))
        lines = lines.select("*", _coded(lists, {c: CODED[c] for c in CODED_LINES}).alias(CODES),
                             (_number_or_null("l_linenumber", 27) + low).alias(PLACE)
                             ).drop("l_linenumber", CLASSES, *place, *[c for c in CODED_LINES if c in lists])
        p = p.select("*", _coded(lists, {c: CODED[c] for c in CODED_PARTS}).alias("p_codes"), sizes.cast("long").alias("p_sizes")).drop("p_size", *[c for c in CODED_PARTS if c in lists])
        numbers = [col(CODES).bitwiseOR(col("p_codes")).alias(CODES), (col(PLACE) + col("p_sizes")).alias(PLACE)]
    x = lines.join(p, col("l_partkey") == col("p_partkey")).join(s, col("l_suppkey") == col("s_suppkey"))
    return x.select(
        *[c for c in lines.columns if c not in ("l_partkey", "l_suppkey", CLASSES, CODES, PLACE)],
        *[c for c in CODED_PARTS if c in p.columns],
        F.when(col("s_suppkey") % 33 == 0, F.lit("")).otherwise(col("s_name")).alias("transportista"),
        *numbers,
    )


def billing_keys(x: DataFrame, lists: dict[str, list[str]] | None = None) -> DataFrame:
    """The mapped columns that rows are sorted by inside a file, beside those of :func:`billing_rows`."""
    if lists is not None:
        x = x.withColumns(_decoded(lists, {"nombre_compania": CODED["nombre_compania"]}, CODES, 255)).withColumn(CLASSES, F.col(PLACE).bitwiseAND(F.lit(1023)).cast("int"))
    return x.withColumns({
        "estado_contable": F.when(_is_class(STATUS, 0), F.lit("Facturado")).when(_is_class(STATUS, 1), F.lit("Sin Facturar"))
        .when(_is_class(STATUS, 2), F.lit("Anulado")),
        BILLING_MONTH_PARTITION: month_key(F.col("fecha_creacion")),
    })


def billing_columns(x: DataFrame, lists: dict[str, list[str]]) -> DataFrame:
    """What :func:`map_billing` maps, from the rows of :func:`billing_rows` with ``lists``; a projection."""
    places = {c: p for c, p in CODED.items() if c not in x.columns}
    return x.withColumns({"l_linenumber": _number_back(27), **_decoded(lists, places, CODES, 255)})


def map_billing(x: DataFrame) -> DataFrame:
    """The billing columns; a projection, so the order of rows stays."""
    col = F.col
    line = col("l_linenumber")
    order = col("l_orderkey").cast("string")  # the order's own key too, as the lines are joined on it
    return x.select(
        "fecha_creacion",
        col("l_shipdate").alias("fecha"),
        "tarifa_final",
        "nombre_compania",
        col("nombre_compania").alias("compania"),
        col("c_name").alias("nombre_sucursal"),
        "transportista",
        "estado_contable",
        F.when(_is_class(FLT, 0), F.lit("")).when(col("l_linestatus") == "F", F.lit("Con FLT"))
        .when(col("l_linestatus") == "O", F.lit("Sin FLT"))
        .alias("estado_flt"),
        F.when(line % 3 == 0, F.lit("CONFIRMADO")).when(line % 3 == 1, F.lit("POR CONFIRMAR")).alias("estado_flete"),
        F.when(col("o_orderpriority") == "1-URGENT", F.lit("CONCILIADO"))
        .when(col("o_orderpriority") != "5-LOW", col("o_orderpriority"))
        .alias("estado_conciliacion"),
        F.when(col("l_returnflag") == "R", F.lit("COBRADO"))
        .when(col("l_returnflag") == "A", F.lit("PENDIENTE"))
        .when(line % 2 != 0, F.lit(""))
        .alias("status_crisar"),
        F.when(_is_class(QUANTITY, 0), F.lit("ACEPTADO"))
        .when(_is_class(QUANTITY, 1), F.lit("PENDIENTE"))
        .when(_is_class(QUANTITY, 2), F.lit("Anulado"))
        .otherwise(F.lit(""))
        .alias("estado_envio_factura"),
        col("p_type").alias("tipo_fact"),
        col("p_brand").alias("tipo_proceso"),
        col("c_mktsegment").alias("aprobacion"),
        F.concat(col("l_returnflag"), col("l_linestatus")).alias("status_contabilidad_aje"),
        F.when(_is_class(SIZE, 0), F.lit("S")).when(_is_class(SIZE, 1), F.lit("M")).otherwise(F.lit("L"))
        .alias("tipo_transporte"),
        col("p_type").alias("como_factura"),
        col("p_name").alias("motivo"),
        col("l_linestatus").alias("Filtro"),
        col("p_name").alias("observacion"),
        col("p_name").alias("titulo"),
        F.concat(order, F.lit("-"), line.cast("string")).alias("id_envio"),
        order.alias("n_flete"),
        order.alias("nro_factura"),
        _trip_state(_is_class(ARRIVAL, 0)).alias("estado_viaje"),
        BILLING_MONTH_PARTITION,
        *([POSITION] if POSITION in x.columns else []),
    )


def build_billing(t: dict[str, DataFrame]) -> DataFrame:
    return map_billing(billing_keys(billing_rows(t)))


def build_trips(t: dict[str, DataFrame]) -> DataFrame:
    s = t["supplier"].select("s_suppkey", "s_name", "s_nationkey")
    r = t["region"].select(F.col("r_regionkey").alias("cr_regionkey"), F.col("r_name").alias("cr_region"))
    x = (
        _lines(t)
        .join(r, F.col("cn_regionkey") == F.col("cr_regionkey"))
        .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(_nation(t, "sn"), F.col("s_nationkey") == F.col("sn_nationkey"))
    )
    col = F.col
    line = col("l_linenumber")
    late = F.when(col("l_suppkey") % 17 != 0, (col("l_partkey") % 13).cast("int") - 3)
    return x.select(
        col("l_orderkey").cast("string").alias("referencia"),
        col("sn_nation").alias("origen"),
        col("sn_nation").alias("origen_carga"),
        col("cn_nation").alias("destino"),
        F.when(line == 6, F.lit("")).otherwise(col("cn_nation")).alias("destino_carga"),
        F.when(col("c_custkey") % 29 != 0, col("cr_region")).alias("zona"),
        col("cn_nation").alias("departamento"),
        col("c_name").alias("cliente_final"),
        col("o_orderpriority").alias("atencion"),
        col("c_mktsegment").alias("empresa"),
        F.when(line == 2, F.lit("")).when(line == 3, F.lit("---")).when(line != 1, col("s_name")).alias("placa"),
        _on_time_label(late).alias("NS"),
        _on_time_label(late).alias("on_time"),
        _trip_state(col("l_shipdate") <= col("o_orderdate")).alias("estado_viaje"),
        late.alias("dias_retrazo"),
        F.when(col("l_tax") != 0, F.lit(100) - F.lit(100) * col("l_discount")).alias("porcentaje_cumplimiento"),
        F.when(line != 7, col("o_orderdate").cast("date")).alias("compromiso_de_carga"),
        col("l_shipdate").alias("fecha_carga"),
        col("l_shipdate").alias("actualizacion"),
    )


def build_on_time(t: dict[str, DataFrame]) -> DataFrame:
    status = F.col("o_orderstatus")
    return t["orders"].select(
        F.col("o_orderdate").alias("fecha"),
        F.when(status == "F", F.lit("ON TIME")).when(status == "O", F.lit("OFF TIME")).alias("on_time"),
    )


def build_orders(t: dict[str, DataFrame]) -> DataFrame:
    return t["orders"].select(F.col("o_orderstatus").alias("estado"))


def build_dispatch(t: dict[str, DataFrame]) -> DataFrame:
    li = t["lineitem"].select("l_suppkey")
    s = t["supplier"].select("s_suppkey", "s_nationkey")
    return (
        li.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(_nation(t, "sn"), F.col("s_nationkey") == F.col("sn_nationkey"))
        .select(F.col("sn_nation").alias("nom_planta"))
    )


BUILDERS = {
    LINE_ORDERS: (build_line_orders, ("lineitem", "orders", "customer", "nation")),
    "billing": (build_billing, ("lineitem", "orders", "customer", "nation", "supplier", "part")),
    "trips": (build_trips, ("lineitem", "orders", "customer", "nation", "region", "supplier")),
    "on_time": (build_on_time, ("orders",)),
    "orders": (build_orders, ("orders",)),
    "dispatch": (build_dispatch, ("lineitem", "supplier", "nation")),
}

# Roles whose rows are shuffled narrow, by lists of values that the build finds: (the lists, the rows).
NARROW = {LINE_ORDERS: (flag_lists, build_line_orders), "billing": (value_lists, billing_rows)}
# Of those, with a mapping after the sort: (in-file sort keys from the rows, further ones that keep an order's lines together
# in files, the mapping).
LATE = {"billing": (billing_keys, ("l_orderkey", PLACE), lambda x, lists: map_billing(billing_columns(x, lists)))}
# Written roles that are made from the parts of the joined lines; the others read their sources.
FROM_LINES = ("billing", "trips")
# The source whose new files a part can be made from alone: the other sources are complete on the join's other side.
FACT = ("lineitem",)
WRITTEN_SOURCES = ("lineitem", "orders", "customer", "nation", "region", "supplier", "part")

# The pinned snapshot of each input folder of this application.
_MEMO: dict[tuple[str, str, str], Snapshot] = {}


# Raise this number when a mapping, a file layout or a scalar that the mappings use changes.
MAPPING_VERSION = 8


def _root(base: str, sf_dir: str, name: str) -> str:
    """Where a role's parts and commits lie: by input folder, mapping version and file layout."""
    folder = os.path.abspath(sf_dir) if "://" not in sf_dir else sf_dir
    key = "\n".join([folder, name, str(MAPPING_VERSION), repr(MATERIALISED.get(name))])
    return f"{base}/cargoscope-roles/{name}-{hashlib.sha1(key.encode()).hexdigest()[:16]}"


def snapshot(spark: SparkSession, sf_dir: str, new: bool = False) -> Snapshot:
    """The pinned snapshot of the input folder; ``new`` takes another one, which lists the source files again."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), checkpoint_dir(spark) or "")
    if new or key not in _MEMO:
        _MEMO[key] = Snapshot(row_session(spark), sf_dir, WRITTEN_SOURCES)
    return _MEMO[key]


def refresh(spark: SparkSession, sf_dir: str) -> Snapshot:
    """Follow the source files as they are now: later calls read rows that were added since the last snapshot."""
    return snapshot(spark, sf_dir, new=True)


def _warn_if_skew_handling_off(spark: SparkSession) -> None:
    """Hot join keys in the build are split by AQE's skew join; say so when a session turns it off."""
    def on(key: str, default: str) -> bool:
        return str(spark.conf.get(key, default)).lower() == "true"

    if not (on("spark.sql.adaptive.enabled", "true") and on("spark.sql.adaptive.skewJoin.enabled", "true")):
        warnings.warn("adaptive skew-join handling is off: a customer, supplier or part holding a large share "
                      "of the rows will be joined in one task", RuntimeWarning, stacklevel=3)


def lazy_role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The role frame as a lazy plan over the base tables (no materialisation)."""
    name = ROLE_ALIASES.get(name, name)
    if name not in BUILDERS:
        raise KeyError(f"unknown role {name!r}; known: {', '.join(ROLE_NAMES)}")
    builder, sources = BUILDERS[name]
    return builder({n: table(spark, sf_dir, n) for n in sources})


def _positioned(lines: DataFrame) -> DataFrame:
    """Lines with POSITION: file (hashed) and row index of the line, fixed by the source files alone."""
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return lines.select("*", place.alias(POSITION))


def _short_position(lines: DataFrame) -> DataFrame:
    """POSITION in 16 bits of the file's hash and the row index: as a tie-break it goes through shuffles.

    Rows of one position are only range-partitioned together if their other keys are equal too, so that a group of exact
    copies spreads over as many as 65,536 partitions, and equal bits change no row.
    """
    place = F.col(f"{POSITION}.file").bitwiseXOR(F.col(f"{POSITION}.row")).bitwiseAND(F.lit(0xFFFF))
    return lines.withColumn(POSITION, place.cast("int"))


def positioned_role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The lazy role with POSITION."""
    builder, sources = BUILDERS[name]
    t = {n: table(spark, sf_dir, n) for n in sources}
    return builder(t | {"lineitem": _positioned(t["lineitem"])})


def read_parts(spark: SparkSession, sf_dir: str, name: str, parts: list[str]) -> DataFrame:
    """One scan of a written table's parts, with the mapping's own schema: folder values keep their type instead of
    what partition inference would make of them."""
    frame = _short_position(positioned_role(spark, sf_dir, name)) if name == LINE_ORDERS else lazy_role(spark, sf_dir, name)
    schema = frame.schema
    reader = spark.read.schema(StructType([*schema.fields, StructField("part", StringType())]))
    return reader.option("basePath", parts[0].rsplit("/", 1)[0]).parquet(*parts).select(*schema.names)


def _write(t: dict[str, DataFrame], name: str, part: str) -> None:
    """Write the joined rows of a role: range partitions first, then sort keys, the sort and the mapping."""
    range_keys, cluster, folder_col = MATERIALISED[name]
    make_lists, rows = NARROW.get(name, (lambda t: None, lambda t, lists: BUILDERS[name][0](t)))
    lists = make_lists(t)
    frame = rows(t, lists)
    if range_keys:
        frame = frame.repartitionByRange(*range_keys)
    if name != LINE_ORDERS and POSITION in frame.columns:
        frame = frame.drop(POSITION)
    mapping = None
    if name in LATE:
        sort_keys, further, late = LATE[name]
        frame, cluster, mapping = sort_keys(frame, lists), (*cluster, *further), lambda x: late(x, lists)
    write_skippable(frame, part, cluster, LOOKUP.get(name, ()), folder_col, finish=mapping)


def ensure(seen: Snapshot, name: str, base: str, rebuild: bool = False) -> dict:
    """The commit of a written role that covers the snapshot, made now if there is none.

    Lines and dispatch add a part with the joins of new lineitem files; billing and trips add one for the parts of the
    lines that they don't cover. Everything else that changed is a full build.
    """
    spark, sf_dir = seen.spark, seen.sf_dir
    sources = BUILDERS[name][1]
    commits, version = Commits(spark, _root(base, sf_dir, name)), seen.version(sources)
    record = None if rebuild else commits.latest()
    if record and record["version"] == version:
        return record
    _warn_if_skew_handling_off(spark)
    spark = seen.builder()
    t = {n: table(spark, sf_dir, n) for n in sources}
    seen.check_unchanged(sources)
    parts, made_from = [], []
    if name in FROM_LINES:
        lines = ensure(seen, LINE_ORDERS, base)["parts"]
        own = [n for n in sources if n not in BUILDERS[LINE_ORDERS][1]]
        if record and set(record["made_from"]) <= set(lines) and len(record["parts"]) < MOST_PARTS and all(
                record["version"].get(n) == version[n] for n in own):
            parts, made_from = record["parts"], record["made_from"]
        new = [p for p in lines if p not in made_from]
        if new:
            parts = [*parts, commits.new_part()]
            _write(t | {LINE_ORDERS: read_parts(spark, sf_dir, LINE_ORDERS, new)}, name, parts[-1])
        made_from = lines
    else:
        added = added_files(spark, record, seen.files(sources), version, FACT) if record else None
        lineitem = t["lineitem"]
        if added:
            parts, lineitem = record["parts"], spark.read.schema(lineitem.schema).parquet(*added["lineitem"])
        parts = [*parts, commits.new_part()]
        _write(t | {"lineitem": _short_position(_positioned(lineitem)) if name == LINE_ORDERS else lineitem}, name, parts[-1])
    return commits.commit(parts, version, seen.files(sources), made_from)


def role(spark: SparkSession, sf_dir: str, name: str, refresh: bool = False, written: bool = True) -> DataFrame:
    """The role frame ``name``; lineitem-grain roles are read from their written table.

    The table follows the pinned snapshot of the input folder: the first call lists the source files and uses, extends
    or builds the newest commit below the session's checkpoint folder; later calls read it without any job. Rows added
    since then are seen after :func:`refresh`, or by a new process. ``refresh=True`` takes a new snapshot and builds the
    table anew even if one exists. Commits of concurrent builders never touch each other's files. ``written=False``
    asks for the lazy joins instead; without a checkpoint folder, or if the write fails, the call is an error.
    """
    name = ROLE_ALIASES.get(name, name)
    if name not in MATERIALISED or not written:
        return lazy_role(spark, sf_dir, name)
    base = checkpoint_dir(spark)
    if base is None:
        raise ValueError("spark.checkpoint.dir must name a shared folder for the written role tables; "
                         "written=False gives the lazy joins")
    seen = snapshot(spark, sf_dir, new=refresh)
    # The first call makes the table; a sibling session reads the same parts through a frame of its own.
    if refresh or ("parts", name) not in seen.notes:
        seen.notes["parts", name] = ensure(seen, name, base, rebuild=refresh)["parts"]
    key = f"{name}@{id(spark._jsparkSession) if spark is not seen.spark else ''}"
    if key not in seen.roles:
        seen.roles[key] = read_parts(spark, sf_dir, name, seen.notes["parts", name])
    return seen.roles[key]


def parts(spark: SparkSession, sf_dir: str, name: str) -> list[str]:
    """The parts of a written role's table, as the pinned snapshot sees it; the table is made if need be."""
    name = ROLE_ALIASES.get(name, name)
    role(spark, sf_dir, name)
    return snapshot(spark, sf_dir).notes["parts", name]


def month_directory(spark: SparkSession, sf_dir: str) -> list[tuple[str | None, int]]:
    """Rows of the billing table per creation month, newest first: counted once a snapshot, from file metadata."""
    from cargoscope.operators.paging import folder_counts

    return snapshot(spark, sf_dir).note(("directory",), lambda: folder_counts(role(spark, sf_dir, "billing"), BILLING_MONTH_PARTITION))


def build_roles(spark: SparkSession, sf_dir: str, refresh: bool = False) -> dict[str, DataFrame]:
    """Materialise every written role at once: the joined lines first, once, then billing and trips from them.

    Independent builds are submitted from separate threads, so the scheduler runs them side by side: one build's narrow
    stages (a scan that is a single split, a write) overlap the others' wide ones.
    """
    from concurrent.futures import ThreadPoolExecutor

    base = checkpoint_dir(spark)
    if base is None:
        raise ValueError("spark.checkpoint.dir must name a shared folder for the written role tables")
    seen = snapshot(spark, sf_dir, new=refresh)
    seen.version(WRITTEN_SOURCES)

    def after_lines(name: str, lines) -> dict:
        lines.result()
        return ensure(seen, name, base, refresh)

    with ThreadPoolExecutor(max_workers=len(MATERIALISED)) as pool:
        lines = pool.submit(ensure, seen, LINE_ORDERS, base, refresh)
        others = {n: pool.submit(after_lines, n, lines) if n in FROM_LINES else pool.submit(ensure, seen, n, base, refresh)
                  for n in MATERIALISED if n != LINE_ORDERS}
        records = {n: f.result() for n, f in others.items()}
    seen.notes.update({("parts", n): r["parts"] for n, r in records.items()})
    return {n: role(spark, sf_dir, n) for n in records}


class RoleCatalog(Mapping):
    """The allow-listed role frames of one input folder, built only when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if ROLE_ALIASES.get(name, name) not in ROLE_NAMES:
            raise KeyError(name)
        return role(self.spark, self.sf_dir, name)

    def __iter__(self):
        return iter(ROLE_NAMES)

    def __len__(self) -> int:
        return len(ROLE_NAMES)


def roles(spark: SparkSession, sf_dir: str) -> RoleCatalog:
    return RoleCatalog(spark, sf_dir)
