"""DuckDB twins of the registered queries, for the correctness check.

Each SQL text starts with the role-frame CTEs it needs (the same column mapping
as sources/roles.py, written out in SQL) and computes the query in DuckDB's own
dialect. Rounding uses the exact integer half-up formula (R5), NULL order is
spelled out wherever a LIMIT or OFFSET follows (R7), and ties are broken by the
same complete key lists as the Spark side (R8). Output types are aligned with
the Spark edge form: counts BIGINT, money and shares DOUBLE, datetimes ISO text.
"""

from __future__ import annotations

from cargoscope.plans.registry import (AS_OF, DISPATCH_ARGS, EXECUTIVE_ARGS, FACT_FILTER_ARGS, FACT_PAGE,
                                       MONTH_RANGE_ARGS, PANEL_FACT_ARGS, PANEL_TRIP_ARGS, PENDING_ARGS, RANKING_ARGS,
                                       TRIP_FILTER_ARGS, ZONE_ARGS)

# --- fixed values, written out here so that a wrong entry on the Spark side shows -----------

FILTER_COLUMNS = {
    "compania": "nombre_compania", "estado_contable": "estado_contable", "estado_flete": "estado_flete",
    "estado_flt": "estado_flt", "estado_conciliacion": "estado_conciliacion", "status_crisar": "status_crisar",
    "tipo_fact": "tipo_fact", "status_cont_aje": "status_contabilidad_aje", "aprobacion": "aprobacion",
    "tipo_proceso": "tipo_proceso", "estado_envio_factura": "estado_envio_factura",
}
FACT_FACETS = {
    "companias": "nombre_compania", "estados_contables": "estado_contable", "estados_flete": "estado_flete",
    "estados_flt": "estado_flt", "estados_conciliacion": "estado_conciliacion", "status_crisar": "status_crisar",
    "tipos_fact": "tipo_fact", "status_cont_aje": "status_contabilidad_aje", "aprobaciones": "aprobacion",
    "tipos_proceso": "tipo_proceso", "estados_envio_factura": "estado_envio_factura",
}
FREIGHT_FACET_COLUMNS = ["nombre_compania", "transportista", "estado_contable", "estado_flete", "tipo_transporte",
                         "estado_conciliacion", "nombre_sucursal"]
TRIP_FACETS = {"plantas": "origen_carga", "destinos": "destino_carga", "zonas": "zona"}
TRIP_FACETS_EXTENDED = {c: c for c in ("origen_carga", "destino_carga", "zona", "atencion", "empresa")}
STATUS_GROUPS = {"Contable": "estado_contable", "FLT": "estado_flt", "Conciliacion": "estado_conciliacion",
                 "Flete": "estado_flete"}
EXPORT_SQL = """SELECT nombre_compania AS compania, nombre_sucursal AS sucursal,
  strftime(fecha_creacion, '%d-%m-%Y') AS fecha, titulo, id_envio, observacion,
  CAST(tarifa_final AS DOUBLE) AS tarifa_final, n_flete, estado_contable, estado_conciliacion, estado_flt,
  status_crisar, tipo_fact, tipo_proceso, aprobacion, estado_envio_factura
FROM billing ORDER BY fecha_creacion DESC NULLS LAST"""
VIEW_DETAIL_COLUMNS = ["fecha", "nombre_compania", "nombre_sucursal", "titulo", "transportista", "tarifa_final",
                       "estado_flete", "estado_contable", "estado_envio_factura", "status_crisar", "tipo_fact",
                       "estado_conciliacion", "tipo_transporte", "n_flete", "nro_factura"]
DUE_SOON_COLUMNS = ("referencia", "destino", "destino_carga", "cliente_final", "fecha_carga", "compromiso_de_carga",
                    "estado_viaje", "NS", "on_time")
TRIP_TABLE_COLUMNS = ("referencia", "origen", "destino", "zona", "cliente_final", "placa", "compromiso_de_carga",
                      "fecha_carga", "NS", "dias_retrazo", "porcentaje_cumplimiento", "estado_viaje")

# --- role frames -----------------------------------------------------------------

CTE = {
    "billing": """billing AS (
  SELECT
    CASE WHEN l.l_suppkey % 50 <> 7 THEN o.o_orderdate END AS fecha_creacion,
    l.l_shipdate AS fecha,
    CASE WHEN l.l_partkey % 97 <> 0 THEN CAST(l.l_extendedprice AS DECIMAL(18,2)) END AS tarifa_final,
    CASE WHEN c.c_custkey % 40 <> 0 THEN cn.n_name END AS nombre_compania,
    CASE WHEN c.c_custkey % 40 <> 0 THEN cn.n_name END AS compania,
    c.c_name AS nombre_sucursal,
    CASE WHEN s.s_suppkey % 33 = 0 THEN '' ELSE s.s_name END AS transportista,
    CASE WHEN o.o_orderstatus = 'F' THEN 'Facturado' WHEN o.o_orderstatus = 'O' THEN 'Sin Facturar'
         WHEN o.o_orderstatus = 'P' THEN 'Anulado' END AS estado_contable,
    CASE WHEN l.l_suppkey % 25 = 3 THEN '' WHEN l.l_linestatus = 'F' THEN 'Con FLT'
         WHEN l.l_linestatus = 'O' THEN 'Sin FLT' END AS estado_flt,
    CASE WHEN l.l_linenumber % 3 = 0 THEN 'CONFIRMADO' WHEN l.l_linenumber % 3 = 1 THEN 'POR CONFIRMAR' END
      AS estado_flete,
    CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'CONCILIADO' WHEN o.o_orderpriority <> '5-LOW'
         THEN o.o_orderpriority END AS estado_conciliacion,
    CASE WHEN l.l_returnflag = 'R' THEN 'COBRADO' WHEN l.l_returnflag = 'A' THEN 'PENDIENTE'
         WHEN l.l_linenumber % 2 <> 0 THEN '' END AS status_crisar,
    CASE WHEN l.l_quantity <= 20 THEN 'ACEPTADO' WHEN l.l_quantity <= 40 THEN 'PENDIENTE'
         WHEN l.l_quantity < 50 THEN 'Anulado' ELSE '' END AS estado_envio_factura,
    p.p_type AS tipo_fact,
    p.p_brand AS tipo_proceso,
    c.c_mktsegment AS aprobacion,
    l.l_returnflag || l.l_linestatus AS status_contabilidad_aje,
    CASE WHEN p.p_size <= 10 THEN 'S' WHEN p.p_size <= 30 THEN 'M' ELSE 'L' END AS tipo_transporte,
    p.p_type AS como_factura,
    p.p_name AS motivo,
    l.l_linestatus AS Filtro,
    p.p_name AS observacion,
    p.p_name AS titulo,
    CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS id_envio,
    CAST(l.l_orderkey AS VARCHAR) AS n_flete,
    CAST(o.o_orderkey AS VARCHAR) AS nro_factura,
    CASE WHEN l.l_shipdate <= o.o_orderdate THEN 'Llegó a tiempo' ELSE 'Tarde' END AS estado_viaje
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN part p ON l.l_partkey = p.p_partkey
)""",
    "trips": """trip_base AS (
  SELECT l.*, o.o_orderdate, o.o_orderpriority, c.c_custkey, c.c_name, c.c_mktsegment,
         cn.n_name AS cn_nation, r.r_name AS cr_region, s.s_name, sn.n_name AS sn_nation,
         CASE WHEN l.l_suppkey % 17 <> 0 THEN CAST(l.l_partkey % 13 AS INTEGER) - 3 END AS late
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN region r ON cn.n_regionkey = r.r_regionkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation sn ON s.s_nationkey = sn.n_nationkey
),
trips AS (
  SELECT
    CAST(l_orderkey AS VARCHAR) AS referencia,
    sn_nation AS origen,
    sn_nation AS origen_carga,
    cn_nation AS destino,
    CASE WHEN l_linenumber = 6 THEN '' ELSE cn_nation END AS destino_carga,
    CASE WHEN c_custkey % 29 <> 0 THEN cr_region END AS zona,
    cn_nation AS departamento,
    c_name AS cliente_final,
    o_orderpriority AS atencion,
    c_mktsegment AS empresa,
    CASE WHEN l_linenumber = 2 THEN '' WHEN l_linenumber = 3 THEN '---' WHEN l_linenumber <> 1 THEN s_name END
      AS placa,
    CASE WHEN late IS NULL OR late <= 0 THEN 'ON TIME' ELSE 'OFF TIME' END AS NS,
    CASE WHEN late IS NULL OR late <= 0 THEN 'ON TIME' ELSE 'OFF TIME' END AS on_time,
    CASE WHEN l_shipdate <= o_orderdate THEN 'Llegó a tiempo' ELSE 'Tarde' END AS estado_viaje,
    late AS dias_retrazo,
    CASE WHEN l_tax <> 0 THEN 100 - 100 * l_discount END AS porcentaje_cumplimiento,
    CASE WHEN l_linenumber <> 7 THEN CAST(o_orderdate AS DATE) END AS compromiso_de_carga,
    l_shipdate AS fecha_carga,
    l_shipdate AS actualizacion
  FROM trip_base
)""",
    "on_time": """on_time AS (
  SELECT o_orderdate AS fecha,
         CASE WHEN o_orderstatus = 'F' THEN 'ON TIME' WHEN o_orderstatus = 'O' THEN 'OFF TIME' END AS on_time
  FROM orders
)""",
    "orders_role": """orders_role AS (SELECT o_orderstatus AS estado FROM orders)""",
    "dispatch": """dispatch AS (
  SELECT sn.n_name AS nom_planta
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation sn ON s.s_nationkey = sn.n_nationkey
)""",
}


def with_roles(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names) + "\n"


# --- expression helpers (DuckDB dialect) --------------------------------------------

AMT = "tarifa_final"


def ratio(n: str, d: str, dp: int) -> str:
    """n / d rounded half away from zero at dp decimals, DOUBLE; NULL when d is 0 or NULL."""
    s = 10 ** dp
    N = f"CAST(({n}) AS HUGEINT)"
    D = f"CAST(({d}) AS HUGEINT)"
    return (f"(CASE WHEN {D} <> 0 THEN CAST(sign({N}) * sign({D}) * ((2 * abs({N}) * {s} + abs({D})) "
            f"// (2 * abs({D}))) AS DOUBLE) / CAST({s} AS DOUBLE) END)")


def cents(e: str) -> str:
    return f"CAST(({e}) * 100 AS HUGEINT)"


def dbl(e: str) -> str:
    return f"CAST({e} AS DOUBLE)"


def msum(x: str = AMT) -> str:
    return f"SUM({x})"


def mif(p: str, x: str = AMT) -> str:
    return f"SUM(CASE WHEN {p} THEN {x} ELSE 0 END)"


def mavg(x: str = AMT) -> str:
    return ratio(cents(f"SUM({x})"), f"COUNT({x}) * 100", 2)


def mshare(part: str, whole: str = "SUM(tarifa_final)") -> str:
    return ratio(f"{cents(part)} * 100", cents(whole), 1)


def cshare(part: str, whole: str) -> str:
    return ratio(f"({part}) * 100", whole, 1)


def cif(p: str) -> str:
    return f"count(*) FILTER (WHERE {p})"


def avg6(x: str, dp: int) -> str:
    return ratio(f"CAST(SUM(CAST({x} AS DECIMAL(18,6))) * 1000000 AS HUGEINT)", f"COUNT({x}) * 1000000", dp)


def avg_int(x: str, dp: int) -> str:
    return ratio(f"SUM({x})", f"COUNT({x})", dp)


def ts(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%dT%H:%M:%S')"


def dt(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%d')"


def mk(e: str) -> str:
    return f"strftime({e}, '%Y-%m')"


def zero(e: str) -> str:
    return f"COALESCE({e}, 0.0)"


BILLED = "estado_contable = 'Facturado'"
UNBILLED = "estado_contable = 'Sin Facturar'"
CANCELLED = "estado_contable = 'Anulado'"
COLLECTED = "status_crisar = 'COBRADO'"
WITH_FLT = "estado_flt = 'Con FLT'"
WITHOUT_FLT = "estado_flt = 'Sin FLT'"
CONFIRMED = "estado_flete = 'CONFIRMADO'"
TO_CONFIRM = "estado_flete = 'POR CONFIRMAR'"
ACCEPTED = "estado_envio_factura = 'ACEPTADO'"


def block(p: str, n: str | None, a: str | None, pct: str | None = None) -> list[str]:
    out = []
    if n:
        out.append(f"{cif(p)} AS {n}")
    if a:
        out.append(f"{dbl(mif(p))} AS {a}")
    if pct:
        out.append(f"{mshare(mif(p))} AS {pct}")
    return out


def sel(items: list[str]) -> str:
    return ",\n  ".join(items)


def order_all(keys: list[tuple[str, str]], columns: list[str]) -> str:
    """ORDER BY the explicit keys, then every other column ascending (as sort_keys in Spark)."""
    parts, used = [], set()
    for c, d in keys:
        parts.append(f"{c} DESC NULLS LAST" if d == "desc" else f"{c} ASC NULLS FIRST")
        used.add(c)
    parts += [f"{c} ASC NULLS FIRST" for c in columns if c not in used]
    return ", ".join(parts)


def fact_where(args: dict[str, str], date_col: str = "fecha_creacion") -> str:
    clauses = [f"{FILTER_COLUMNS[k]} = '{v}'" for k, v in args.items() if k in FILTER_COLUMNS and v]
    if args.get("mes_desde"):
        clauses.append(f"{date_col} >= TIMESTAMP '{args['mes_desde']}-01'")
    if args.get("mes_hasta"):
        clauses.append(f"{date_col} < TIMESTAMP '{args['mes_hasta']}-01' + INTERVAL 1 MONTH")
    return " AND ".join(clauses) or "TRUE"


# --- query bodies -------------------------------------------------------------------------

def _monthly(table: str, date_col: str, measures: list[str], where: str = "TRUE",
             extra_keys: list[tuple[str, str]] = ()) -> str:
    keys = [(mk(date_col), "mes"), *extra_keys]
    key_sel = [f"{e} AS {n}" for e, n in keys]
    group = ", ".join(e for e, _ in keys)
    return (f"SELECT {sel(key_sel + measures)}\nFROM {table}\nWHERE {date_col} IS NOT NULL AND ({where})\n"
            f"GROUP BY {group}")


def _trend_measures() -> list[str]:
    return [
        f"{dbl(msum())} AS total", f"{dbl(mif(BILLED))} AS facturado", f"{dbl(mif(UNBILLED))} AS pendiente",
        f"{dbl(mif(COLLECTED))} AS cobrado", f"{mshare(mif(BILLED))} AS pct_fact",
        f"{mshare(mif(COLLECTED))} AS pct_cobrado", "COUNT(*) AS viajes",
        f"{cif(CONFIRMED)} AS confirmados",
        f"{cif(WITH_FLT)} AS con_flt",
    ]


def _blank(dim: str, blanks: str) -> str:
    return {"keep": "TRUE", "drop_null": f"{dim} IS NOT NULL",
            "drop_blank": f"{dim} IS NOT NULL AND {dim} <> ''"}[blanks]


def _amount_by(table: str, dim: str, blanks: str, with_avg: bool = False,
               names: tuple[str, str, str] = ("viajes", "total", "promedio")) -> str:
    ms = [f"COUNT(*) AS {names[0]}", f"{dbl(msum())} AS {names[1]}"]
    if with_avg:
        ms.append(f"{mavg()} AS {names[2]}")
    return f"SELECT {dim}, {sel(ms)}\nFROM {table}\nWHERE {_blank(dim, blanks)}\nGROUP BY {dim}"


def _count_by(table: str, dim: str, blanks: str) -> str:
    return f"SELECT {dim}, COUNT(*) AS cantidad FROM {table} WHERE {_blank(dim, blanks)} GROUP BY {dim}"


def _compliance_by(dim: str, blanks: str, avg_name: str) -> str:
    return (f"SELECT {dim}, COUNT(*) AS cantidad, {avg6('porcentaje_cumplimiento', 1)} AS {avg_name}\n"
            f"FROM trips WHERE {_blank(dim, blanks)} GROUP BY {dim}")


def _view_measures() -> list[str]:
    return ["COUNT(*) AS total_viajes", f"{dbl(msum())} AS total_tarifa", f"{mavg()} AS tarifa_promedio",
            *block(BILLED, "fact_viajes", "fact_total"), *block(UNBILLED, "pend_viajes", "pend_total")]


def _company_ranking_body(where: str = "TRUE") -> str:
    return f"""SELECT nombre_compania, COUNT(*) AS viajes, SUM(tarifa_final) AS total_dec,
  {mif(BILLED)} AS facturado_dec, {mif(UNBILLED)} AS pendiente_dec, {mif(CANCELLED)} AS anulado_dec,
  {mif(COLLECTED)} AS cobrado_dec, {mshare(mif(BILLED))} AS pct_fact, {mshare(mif(COLLECTED))} AS pct_cobrado,
  {mavg()} AS promedio
FROM billing WHERE nombre_compania IS NOT NULL AND ({where}) GROUP BY nombre_compania"""


def _top_by_amount(table: str, group: list[str], k: int, keep: str, names=("viajes", "total"),
                   bar: bool = False) -> str:
    g = ", ".join(group)
    order = order_all([("total_dec", "desc")], [*group, names[0]])
    bar_col = ""
    if bar:
        bar_col = f", {ratio(cents('total_dec') + ' * 100', 'MAX(' + cents('total_dec') + ') OVER ()', 0)} AS barra_pct"
    return f"""SELECT {g}, {names[0]}, CAST(total_dec AS DOUBLE) AS {names[1]}{bar_col} FROM (
  SELECT {g}, COUNT(*) AS {names[0]}, SUM(tarifa_final) AS total_dec
  FROM {table} WHERE {keep} GROUP BY {g}
  ORDER BY {order} LIMIT {k}
)"""


def _status_panel_body(where: str = "TRUE") -> str:
    branches = [f"SELECT '{g}' AS grupo, {c} AS nombre, tarifa_final FROM billing WHERE {c} IS NOT NULL AND ({where})"
                for g, c in STATUS_GROUPS.items()]
    return ("SELECT grupo, nombre, COUNT(*) AS viajes, SUM(tarifa_final) AS total_dec FROM (\n  "
            + "\n  UNION ALL ".join(branches) + "\n) GROUP BY grupo, nombre")


def _facets_sql(table: str, columns: dict[str, str], months: dict[str, str]) -> str:
    parts = [f"SELECT DISTINCT '{name}' AS facet, CAST({c} AS VARCHAR) AS val FROM {table} "
             f"WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> ''" for name, c in columns.items()]
    parts += [f"SELECT DISTINCT '{name}' AS facet, {mk(c)} AS val FROM {table} WHERE {c} IS NOT NULL"
              for name, c in months.items()]
    return "\nUNION ALL ".join(parts)


def _trip_kpis_sql(where: str = "TRUE") -> str:
    return with_roles("trips") + f"""SELECT total, on_time_ct, off_time_ct,
  {zero(cshare('on_time_ct', 'total'))} AS on_time_pct,
  {zero(cshare('off_time_ct', 'total'))} AS off_time_pct,
  {zero('cumpl_prom')} AS cumpl_prom, {zero('retraso_prom')} AS retraso_prom, con_placa,
  {zero(cshare('con_placa', 'total'))} AS con_placa_pct,
  {ts('ultima_actualizacion')} AS ultima_actualizacion
FROM (
  SELECT COUNT(*) AS total, {cif("NS = 'ON TIME'")} AS on_time_ct, {cif("NS = 'OFF TIME'")} AS off_time_ct,
    {avg6('porcentaje_cumplimiento', 1)} AS cumpl_prom, {avg_int('dias_retrazo', 1)} AS retraso_prom,
    {cif("placa IS NOT NULL AND placa NOT IN ('', '---')")} AS con_placa,
    MAX(actualizacion) AS ultima_actualizacion
  FROM trips WHERE {where}
)"""


def _billing_kpis_body(derived: bool, where: str = "TRUE") -> str:
    items = [
        "COUNT(*) AS total_viajes", "COUNT(DISTINCT nombre_compania) AS companias",
        f"{dbl(msum())} AS tarifa_total", f"{mavg()} AS tarifa_prom",
        *block(BILLED, "facturados", "facturado_total", "pct_facturado"),
        *block(UNBILLED, "sin_facturar", "sin_facturar_total", "pct_sin_facturar"),
        *block(CANCELLED, "anulados", "anulado_total", "pct_anulado"),
        f"{cif(WITH_FLT)} AS con_flt", f"{cif(CONFIRMED)} AS confirmados", f"{cif(TO_CONFIRM)} AS por_confirmar",
        *block(COLLECTED, "cobrados", "cobrado_total"),
    ]
    if derived:
        items += [f"{zero(mshare(mif(BILLED)))} AS pct_fact_calc", f"{zero(mshare(mif(COLLECTED)))} AS pct_cob_calc"]
    return f"SELECT {sel(items)}\nFROM billing WHERE {where}"


def _billing_kpis_sql(derived: bool, where: str = "TRUE") -> str:
    return with_roles("billing") + _billing_kpis_body(derived, where)


def _executive_sql(derived: bool, where: str = "TRUE") -> str:
    items = [
        "COUNT(*) AS total_viajes", f"{dbl(msum())} AS total_tarifa", f"{mavg()} AS tarifa_prom",
        "COUNT(DISTINCT nombre_compania) AS companias",
        *block(BILLED, "fact_viajes", "fact_total", "pct_facturado"),
        *block(UNBILLED, "pend_viajes", "pend_total", "pct_sin_facturar"),
        *block(CANCELLED, "anul_viajes", "anul_total", "pct_anulado"),
        *block(COLLECTED, "cob_viajes", "cob_total", "pct_cobrado"),
        f"{cif(WITH_FLT)} AS con_flt", f"{cif(WITHOUT_FLT)} AS sin_flt", f"{cif(ACCEPTED)} AS env_aceptados",
        f"{cif(CONFIRMED)} AS conf_viajes", f"{cif(TO_CONFIRM)} AS por_confirmar",
    ]
    if derived:
        items += [f"{dbl(msum() + ' - ' + mif(COLLECTED))} AS por_cobrar",
                  f"CAST(CAST(100 AS DECIMAL(5,1)) - CAST(COALESCE({mshare(mif(COLLECTED))}, 0.0) AS DECIMAL(5,1))"
                  " AS DOUBLE) AS pct_pendiente"]
    return with_roles("billing") + f"SELECT {sel(items)}\nFROM billing WHERE {where}"


def _fact_detail_cols(fecha_expr: str = "fecha_creacion") -> list[str]:
    return ["nombre_compania", "nombre_sucursal", "fecha_creacion", f"strftime({fecha_expr}, '%d-%m-%Y') AS fecha",
            "titulo", "id_envio", "observacion", "tarifa_final", "n_flete", "estado_contable",
            "estado_conciliacion", "estado_flt", "status_crisar", "tipo_fact"]


FACT_DETAIL_NAMES = ["nombre_compania", "nombre_sucursal", "fecha_creacion", "fecha", "titulo", "id_envio",
                     "observacion", "tarifa_final", "n_flete", "estado_contable", "estado_conciliacion",
                     "estado_flt", "status_crisar", "tipo_fact"]


def _edge_fact_detail(extra: list[str] = ()) -> str:
    cols = [f"{ts('fecha_creacion')} AS fecha_creacion" if c == "fecha_creacion" else
            "CAST(tarifa_final AS DOUBLE) AS tarifa_final" if c == "tarifa_final" else c
            for c in FACT_DETAIL_NAMES]
    return sel(cols + list(extra))


def _fact_page_sql(page_no: int, size: int, tags: bool, where: str = "TRUE") -> str:
    order = order_all([("fecha_creacion", "desc")], FACT_DETAIL_NAMES)
    extra = []
    if tags:
        extra = ["CASE WHEN estado_contable = 'Facturado' THEN 'Fact' WHEN estado_contable = 'Anulado' THEN 'Anul' "
                 "ELSE 'Pend' END AS tag_contable",
                 "CASE WHEN estado_flt = 'Con FLT' THEN 'Con FLT' ELSE 'Sin FLT' END AS tag_flt",
                 "CASE WHEN status_crisar IS NULL OR status_crisar = '' THEN '-' WHEN status_crisar = 'COBRADO' "
                 "THEN 'cbr' ELSE 'pen' END AS tag_crisar"]
    return with_roles("billing") + f"""SELECT {_edge_fact_detail(extra)} FROM (
  SELECT {sel(_fact_detail_cols())} FROM billing WHERE {where}
  ORDER BY {order} LIMIT {size} OFFSET {(page_no - 1) * size}
)"""


def _fact_pages_sql(pages: int, size: int) -> str:
    order = order_all([("fecha_creacion", "desc")], FACT_DETAIL_NAMES)
    return with_roles("billing") + f"""SELECT {_edge_fact_detail(["CAST((place - 1) // " + str(size) + " + 1 AS INTEGER) AS pagina"])} FROM (
  SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM (SELECT {sel(_fact_detail_cols())} FROM billing)
) WHERE place <= {pages * size}"""


def _trip_top_sql(columns: tuple[str, ...], keys: list[tuple[str, str]], k: int, where: str = "TRUE") -> str:
    order = order_all(keys, list(columns))
    edge = [f"{dt(c)} AS {c}" if c == "compromiso_de_carga" else f"{ts(c)} AS {c}" if c == "fecha_carga" else c
            for c in columns]
    return with_roles("trips") + f"""SELECT {sel(edge)} FROM (
  SELECT {', '.join(columns)} FROM trips WHERE {where} ORDER BY {order} LIMIT {k}
)"""


TRIP_COLUMNS = ["referencia", "origen", "origen_carga", "destino", "destino_carga", "zona", "departamento",
                "cliente_final", "atencion", "empresa", "placa", "NS", "on_time", "estado_viaje", "dias_retrazo",
                "porcentaje_cumplimiento", "compromiso_de_carga", "fecha_carga", "actualizacion"]


def _preview_sql() -> str:
    edge = [f"{dt(c)} AS {c}" if c == "compromiso_de_carga" else
            f"{ts(c)} AS {c}" if c in ("fecha_carga", "actualizacion") else c for c in TRIP_COLUMNS]
    return with_roles("trips") + f"""SELECT {sel(edge)} FROM (
  SELECT * FROM trips ORDER BY {order_all([], TRIP_COLUMNS)} LIMIT 100
)"""


def _trip_filter_where(args: dict[str, str]) -> str:
    cols = {"planta": "origen_carga", "destino": "destino_carga", "zona": "zona"}
    clauses = [f"{cols[k]} = '{v}'" for k, v in args.items() if k in cols and v]
    ns = {"ON_TIME": "ON TIME", "OFF_TIME": "OFF TIME"}.get(args.get("ns", ""))
    if ns:
        clauses.append(f"NS = '{ns}'")
    return " AND ".join(clauses) or "TRUE"


def _share_of_max_dispatch() -> str:
    return with_roles("billing") + f"""SELECT estado_envio_factura, viajes, CAST(total_dec AS DOUBLE) AS total,
  {ratio(cents('total_dec') + ' * 100', 'MAX(' + cents('total_dec') + ') OVER ()', 0)} AS barra_pct,
  CASE WHEN estado_envio_factura = 'ACEPTADO' THEN 'acp' WHEN estado_envio_factura = 'PENDIENTE' THEN 'pen'
       WHEN estado_envio_factura = 'Anulado' THEN 'anl' ELSE 'man' END AS tag_envio
FROM (
  SELECT estado_envio_factura, COUNT(*) AS viajes, SUM(tarifa_final) AS total_dec FROM billing
  WHERE estado_envio_factura IS NOT NULL AND estado_envio_factura <> '' GROUP BY estado_envio_factura
)"""


def _latest_month_sql() -> str:
    return with_roles("billing") + f"""SELECT *, CASE WHEN pct_fact IS NULL THEN NULL WHEN pct_fact >= 80 THEN 'grn'
  WHEN pct_fact >= 50 THEN 'orn' ELSE 'red' END AS banda
FROM ({_monthly('billing', 'fecha_creacion', _trend_measures())}) ORDER BY mes DESC NULLS LAST LIMIT 1"""


def _dept_band_sql() -> str:
    return with_roles("trips") + f"""SELECT departamento, cantidad, cumpl,
  CASE WHEN cumpl >= 100 THEN 'grn' WHEN cumpl >= 90 THEN 'orn' ELSE 'red' END AS banda,
  {ratio('cantidad * 100', 'MAX(cantidad) OVER ()', 0)} AS barra_pct
FROM ({_compliance_by('departamento', 'drop_blank', 'cumpl')})"""


def _company_stack_sql(where: str = "TRUE") -> str:
    return with_roles("billing") + f"""SELECT nombre_compania, viajes, CAST(total_dec AS DOUBLE) AS total,
  CAST(facturado_dec AS DOUBLE) AS facturado, CAST(pendiente_dec AS DOUBLE) AS pendiente,
  CAST(anulado_dec AS DOUBLE) AS anulado, CAST(cobrado_dec AS DOUBLE) AS cobrado, pct_fact, pct_cobrado, promedio,
  CAST(facturado_dec - cobrado_dec AS DOUBLE) AS facturado_no_cobrado,
  {ratio(cents('total_dec') + ' * 100', 'SUM(' + cents('total_dec') + ') OVER ()', 1)} AS pct_total
FROM ({_company_ranking_body(where)})"""


def _company_ranking_sql() -> str:
    return with_roles("billing") + f"""SELECT nombre_compania, viajes, CAST(total_dec AS DOUBLE) AS total,
  CAST(facturado_dec AS DOUBLE) AS facturado, CAST(pendiente_dec AS DOUBLE) AS pendiente,
  CAST(anulado_dec AS DOUBLE) AS anulado, CAST(cobrado_dec AS DOUBLE) AS cobrado, pct_fact, pct_cobrado, promedio
FROM ({_company_ranking_body()})"""


def _share_of_total_sql(where: str = "TRUE") -> str:
    return with_roles("billing") + f"""SELECT grupo, nombre, viajes, CAST(total_dec AS DOUBLE) AS total,
  {ratio(cents('total_dec') + ' * 100', 'SUM(' + cents('total_dec') + ') OVER (PARTITION BY grupo)', 1)} AS pct_grupo
FROM ({_status_panel_body(where)})"""


def _delay_buckets_sql(where: str = "TRUE") -> str:
    return with_roles("trips") + f"""SELECT rango, COUNT(*) AS cantidad FROM (
  SELECT CASE WHEN dias_retrazo IS NULL OR dias_retrazo <= 0 THEN 'A tiempo'
              WHEN dias_retrazo BETWEEN 1 AND 3 THEN '1-3 días'
              WHEN dias_retrazo BETWEEN 4 AND 7 THEN '4-7 días'
              ELSE '+7 días' END AS rango, dias_retrazo FROM trips WHERE {where}
) GROUP BY rango ORDER BY MIN(COALESCE(dias_retrazo, 0))"""


def _pending_top_bars_sql(where: str = "TRUE") -> str:
    return with_roles("billing") + _top_by_amount("billing", ["nombre_compania", "nombre_sucursal"], 10,
                                                  f"{UNBILLED} AND ({where})", bar=True)


def _view_monthly_sql() -> str:
    body = _monthly("billing", "fecha", [*_view_measures(), f"{mshare(mif(BILLED))} AS pct_facturado"],
                    extra_keys=[("date_trunc('month', fecha)", "mes_date_ts")])
    return with_roles("billing") + f"SELECT * EXCLUDE (mes_date_ts), {ts('mes_date_ts')} AS mes_date FROM ({body})"


def _view_on_time_sql() -> str:
    body = _monthly("billing", "fecha", ["COUNT(*) AS total_viajes",
                                         f"{cif("estado_viaje = 'Llegó a tiempo'")} AS on_time"],
                    where="estado_viaje IS NOT NULL", extra_keys=[("nombre_compania", "nombre_compania")])
    return with_roles("billing") + f"SELECT *, {cshare('on_time', 'total_viajes')} AS pct_on_time FROM ({body})"


def _home_summary_sql() -> str:
    return with_roles("billing", "trips", "on_time", "orders_role", "dispatch") + f"""SELECT total_oc, total_fletes,
  total_despachos, total_on_time, {zero(cshare('total_on_time', 'total_ot'))} AS on_time_pct, total_viajes_pend
FROM (SELECT
  (SELECT COUNT(*) FROM orders_role) AS total_oc,
  (SELECT COUNT(*) FROM billing) AS total_fletes,
  (SELECT COUNT(*) FROM dispatch) AS total_despachos,
  (SELECT {cif("on_time = 'ON TIME'")} FROM on_time) AS total_on_time,
  (SELECT COUNT(*) FROM on_time) AS total_ot,
  (SELECT COUNT(*) FROM trips) AS total_viajes_pend)"""


def _table_counts_sql() -> str:
    roles = {"trips": "trips", "on_time": "on_time", "orders": "orders_role", "dispatch": "dispatch",
             "freight": "billing", "validated": "billing"}
    body = "\nUNION ALL ".join(f"SELECT '{n}' AS nombre, COUNT(*) AS filas FROM {t}" for n, t in roles.items())
    return with_roles("billing", "trips", "on_time", "orders_role", "dispatch") + body


def _freight_facets_body() -> str:
    return _facets_sql("billing", {c: c for c in FREIGHT_FACET_COLUMNS}, {"mes": "fecha"})


def _export_sql() -> str:
    return with_roles("billing") + EXPORT_SQL


def _view_detail_sql() -> str:
    cols = [f"{ts('fecha')} AS fecha" if c == "fecha" else "CAST(tarifa_final AS DOUBLE) AS tarifa_final"
            if c == "tarifa_final" else c for c in VIEW_DETAIL_COLUMNS]
    return with_roles("billing") + (f"SELECT {sel(cols)}, {mk('fecha')} AS mes, strftime(fecha, '%Y') AS anio\n"
                                    f"FROM billing WHERE fecha IS NOT NULL ORDER BY billing.fecha DESC NULLS LAST")


def _share_panel_sql(dim: str) -> str:
    return with_roles("billing") + f"""SELECT {dim}, viajes, CAST(total_dec AS DOUBLE) AS total,
  {ratio(cents('total_dec') + ' * 100', 'SUM(' + cents('total_dec') + ') OVER ()', 1)} AS pct_total
FROM (SELECT {dim}, COUNT(*) AS viajes, SUM(tarifa_final) AS total_dec FROM billing
  WHERE {dim} IS NOT NULL AND {dim} <> '' GROUP BY {dim})"""


def _dist(table: str, dim: str, blanks: str, with_avg: bool = False, names=("viajes", "total", "promedio"),
          roles: tuple[str, ...] = ("billing",)) -> str:
    return with_roles(*roles) + _amount_by(table, dim, blanks, with_avg, names)


SQL: dict[str, str] = {
    "preview": _preview_sql(),
    "table_counts": _table_counts_sql(),
    "trips_filtered": with_roles("trips") + "SELECT referencia, origen_carga, destino_carga, zona, NS, dias_retrazo "
                      f"FROM trips WHERE {_trip_filter_where(TRIP_FILTER_ARGS)}",
    "fact_filtered": with_roles("billing") + f"SELECT {_edge_fact_detail()} FROM (SELECT {sel(_fact_detail_cols())} "
                     f"FROM billing WHERE {fact_where(FACT_FILTER_ARGS)})",
    "fact_month_range": with_roles("billing") + _monthly("billing", "fecha_creacion", _trend_measures(),
                                                         where=fact_where(MONTH_RANGE_ARGS)),
    "panel_kpi_filtered": _billing_kpis_sql(derived=True, where=fact_where(PANEL_FACT_ARGS)),
    "panel_status_filtered": _share_of_total_sql(where=fact_where(PANEL_FACT_ARGS)),
    "panel_table_filtered": _fact_page_sql(3, 20, tags=True, where=fact_where(PANEL_FACT_ARGS)),
    "panel_trips_filtered": _trip_kpis_sql(where=_trip_filter_where(PANEL_TRIP_ARGS)),
    "panel_delays_filtered": _delay_buckets_sql(where=_trip_filter_where(PANEL_TRIP_ARGS)),
    "panel_ranking_filtered": _company_stack_sql(where=fact_where(RANKING_ARGS)),
    "panel_pending_filtered": _pending_top_bars_sql(where=fact_where(PENDING_ARGS)),
    "panel_executive_filtered": _executive_sql(derived=True, where=fact_where(EXECUTIVE_ARGS)),
    "panel_dispatch_filtered": with_roles("billing") + f"""SELECT estado_envio_factura, COUNT(*) AS viajes,
  {dbl(msum())} AS total FROM billing WHERE estado_envio_factura IS NOT NULL AND estado_envio_factura <> ''
  AND {fact_where(DISPATCH_ARGS)} GROUP BY estado_envio_factura""",
    "panel_zones_filtered": with_roles("trips") + "SELECT zona, COUNT(*) AS cantidad FROM trips WHERE zona IS NOT NULL "
                            f"AND zona <> '' AND {_trip_filter_where(ZONE_ARGS)} GROUP BY zona",
    "home_summary": _home_summary_sql(),
    "trip_kpis": _trip_kpis_sql(),
    "billing_kpis": _billing_kpis_sql(derived=False),
    "executive_summary": _executive_sql(derived=False),
    "freight_kpis": with_roles("billing") + f"""SELECT COUNT(*) AS total_fletes,
  COUNT(DISTINCT transportista) AS transportistas, COUNT(DISTINCT compania) AS companias,
  {dbl(msum())} AS tarifa_total, {mavg()} AS tarifa_prom, {dbl('MIN(tarifa_final)')} AS tarifa_min,
  {dbl('MAX(tarifa_final)')} AS tarifa_max, {cif("estado_conciliacion = 'CONCILIADO'")} AS conciliados,
  {cif("estado_conciliacion <> 'CONCILIADO' OR estado_conciliacion IS NULL")} AS no_conciliados,
  {cif("estado_flete = 'Facturado'")} AS facturados, {cif("estado_flete <> 'Facturado'")} AS no_facturados
FROM billing""",
    "validation_kpis": with_roles("billing") + f"""SELECT COUNT(*) AS total,
  {sel([*block(BILLED, 'fact_viajes', 'fact_total'), *block(UNBILLED, 'pend_viajes', 'pend_total'),
        *block(CANCELLED, 'anul_viajes', 'anul_total')])},
  {dbl(msum())} AS tarifa_total, {mavg()} AS tarifa_prom,
  {cif("status_crisar IS NOT NULL AND status_crisar <> ''")} AS con_status
FROM billing""",
    "date_ranges": with_roles("billing") + f"""SELECT {ts('MIN(fecha)')} AS min_f, {ts('MAX(fecha)')} AS max_f,
  {ts('MIN(fecha_creacion)')} AS min_fc, {ts('MAX(fecha_creacion)')} AS max_fc FROM billing""",
    "monthly_freight": with_roles("billing") + _monthly("billing", "fecha_creacion", [
        "COUNT(*) AS cantidad", f"{dbl(msum())} AS total_tarifas"]),
    "on_time_trend": with_roles("on_time") + _monthly("on_time", "fecha", [
        f"{cif("on_time = 'ON TIME'")} AS on_time",
        f"{cif("on_time <> 'ON TIME'")} AS off_time", "COUNT(*) AS total"]),
    "monthly_trend": with_roles("billing") + _monthly("billing", "fecha_creacion", _trend_measures()),
    "view_monthly": _view_monthly_sql(),
    "view_on_time": _view_on_time_sql(),
    "monthly_billing": with_roles("billing") + _monthly("billing", "fecha", [
        *block(BILLED, "fact_viajes", "fact_total"), *block(UNBILLED, "pend_viajes", "pend_total")]),
    "monthly_pct_billed": with_roles("billing") + _monthly("billing", "fecha", [
        f"{mshare(mif(BILLED))} AS pct_facturado"]),
    "monthly_fare": with_roles("billing") + _monthly("billing", "fecha", [
        "COUNT(*) AS viajes", f"{dbl(msum())} AS total", f"{mavg()} AS promedio"]),
    "monthly_first3": with_roles("billing") + _monthly("billing", "fecha", ["COUNT(*) AS cantidad"])
    + "\nORDER BY mes ASC NULLS FIRST LIMIT 3",
    "dist_order_state": with_roles("orders_role") + _count_by("orders_role", "estado", "keep"),
    "dist_plant": with_roles("dispatch") + _count_by("dispatch", "nom_planta", "keep"),
    "dist_reconciliation": with_roles("billing") + _count_by("billing", "estado_conciliacion", "keep"),
    "zone_compliance": with_roles("trips") + _compliance_by("zona", "drop_null", "cumplimiento_pct"),
    "dist_zone": with_roles("trips") + _count_by("trips", "zona", "drop_blank"),
    "dist_department": with_roles("trips") + _compliance_by("departamento", "drop_blank", "cumpl"),
    "dist_collection": _dist("billing", "status_crisar", "drop_blank"),
    "dist_dispatch": _dist("billing", "estado_envio_factura", "drop_blank"),
    "dist_bill_type": _dist("billing", "tipo_fact", "drop_blank"),
    "dist_ledger": _dist("billing", "status_contabilidad_aje", "drop_blank"),
    "dist_approval": _dist("billing", "aprobacion", "drop_blank"),
    "dist_process": _dist("billing", "tipo_proceso", "drop_blank"),
    "dist_carrier": _dist("billing", "transportista", "drop_blank", with_avg=True),
    "dist_company": _dist("billing", "nombre_compania", "drop_null"),
    "dist_accounting": _dist("billing", "estado_contable", "drop_null"),
    "dist_reconciliation_value": _dist("billing", "estado_conciliacion", "drop_null"),
    "dist_transport": _dist("billing", "tipo_transporte", "drop_blank", with_avg=True),
    "dist_freight_state": _dist("billing", "estado_flete", "drop_null"),
    "dist_how_billed": _dist("billing", "como_factura", "drop_null"),
    "dist_reason": _dist("billing", "motivo", "drop_blank"),
    "dist_filter": _dist("billing", "Filtro", "drop_blank"),
    "dist_note": _dist("billing", "observacion", "drop_blank"),
    "view_collection": _dist("billing", "status_crisar", "drop_blank", True, ("viajes", "total_tarifa",
                                                                               "tarifa_promedio")),
    "view_dispatch": _dist("billing", "estado_envio_factura", "drop_blank", True, ("viajes", "total_tarifa",
                                                                                    "tarifa_promedio")),
    "company_ranking": _company_ranking_sql(),
    "view_company": with_roles("billing") + f"""SELECT nombre_compania, {sel(_view_measures())},
  {mshare(mif(BILLED))} AS pct_facturado FROM billing WHERE nombre_compania IS NOT NULL GROUP BY nombre_compania""",
    "view_carrier": with_roles("billing") + f"""SELECT transportista, {sel(_view_measures())}
FROM billing WHERE transportista IS NOT NULL AND transportista <> '' GROUP BY transportista""",
    "company_billing": with_roles("billing") + f"""SELECT nombre_compania,
  {sel([*block(BILLED, 'fact_viajes', 'fact_total'), *block(UNBILLED, 'pend_viajes', 'pend_total'),
        *block(CANCELLED, 'anul_viajes', 'anul_total')])}
FROM billing WHERE nombre_compania IS NOT NULL GROUP BY nombre_compania""",
    "delay_buckets": _delay_buckets_sql(),
    "trip_facets": with_roles("trips") + _facets_sql("trips", TRIP_FACETS, {}),
    "trip_facets_extended": with_roles("trips") + _facets_sql("trips", TRIP_FACETS_EXTENDED, {}),
    "fact_facets": with_roles("billing") + _facets_sql("billing", FACT_FACETS, {"meses": "fecha_creacion"}),
    "freight_facets": with_roles("billing") + _freight_facets_body(),
    "freight_facet_counts": with_roles("billing") + f"SELECT facet, COUNT(*) AS n FROM ({_freight_facets_body()}) "
                            "GROUP BY facet",
    "status_panel": with_roles("billing") + "SELECT grupo, nombre, viajes, CAST(total_dec AS DOUBLE) AS total FROM ("
                    + _status_panel_body() + ")",
    "share_of_total": _share_of_total_sql(),
    "share_of_max": _share_of_max_dispatch(),
    "latest_month": _latest_month_sql(),
    "billing_kpis_derived": _billing_kpis_sql(derived=True),
    "company_stack": _company_stack_sql(),
    "receivables": _executive_sql(derived=True),
    "dept_band": _dept_band_sql(),
    "pending_top_bars": _pending_top_bars_sql(),
    "top_companies": with_roles("billing") + _top_by_amount("billing", ["nombre_compania"], 15,
                                                            "nombre_compania IS NOT NULL"),
    "pending_top": with_roles("billing") + _top_by_amount("billing", ["nombre_compania", "nombre_sucursal"], 10,
                                                          UNBILLED),
    "view_pending_top": with_roles("billing") + _top_by_amount(
        "billing", ["nombre_compania", "nombre_sucursal", "transportista"], 20, UNBILLED, ("viajes", "total_pendiente")),
    "pending_top_carrier": with_roles("billing") + _top_by_amount(
        "billing", ["nombre_compania", "nombre_sucursal", "transportista"], 15, UNBILLED),
    "pending_top_bounded": with_roles("billing") + _top_by_amount(
        "billing", ["nombre_compania", "nombre_sucursal", "transportista"], 15, UNBILLED),
    "top_branches": with_roles("billing") + _top_by_amount("billing", ["nombre_sucursal"], 10,
                                                           "nombre_sucursal IS NOT NULL"),
    "trips_due_soon": _trip_top_sql(DUE_SOON_COLUMNS, [("compromiso_de_carga", "asc")], 8,
                                    where=f"(NS = 'OFF TIME' OR (compromiso_de_carga IS NOT NULL AND "
                                          f"compromiso_de_carga <= DATE '{AS_OF}' + INTERVAL 2 DAY))"),
    "trip_table": _trip_top_sql(TRIP_TABLE_COLUMNS, [("porcentaje_cumplimiento", "asc"), ("referencia", "desc")],
                                100),
    "fact_page": _fact_page_sql(*FACT_PAGE, tags=False),
    "fact_page_after": _fact_page_sql(1, 50, tags=False,
                                      where="(fecha_creacion < TIMESTAMP '1996-05-01 00:00:00' OR fecha_creacion IS NULL)"),
    "fact_pages_stepped": _fact_pages_sql(6, 50),
    "fact_page_deep": _fact_page_sql(400, 50, tags=False),
    "share_collection": _share_panel_sql("status_crisar"),
    "share_bill_type": _share_panel_sql("tipo_fact"),
    "share_approval": _share_panel_sql("aprobacion"),
    "share_ledger": _share_panel_sql("status_contabilidad_aje"),
    "fact_tags": _fact_page_sql(1, 50, tags=True),
    "export_detail": _export_sql(),
    "view_detail": _view_detail_sql(),
}
SQL["status_panel_union"] = SQL["status_panel"]
SQL["status_panel_flt"] = f"SELECT * FROM ({SQL['status_panel']}) WHERE grupo = 'FLT'"


def _missing(c: str, default: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN '{default}' ELSE {c} END AS {c}_texto"


SQL["fact_labels"] = f"""SELECT *, substr(COALESCE(nombre_compania, ''), 1, 14) AS nombre_compania_corto,
  substr(COALESCE(nombre_sucursal, ''), 1, 12) AS nombre_sucursal_corto, substr(COALESCE(titulo, ''), 1, 20) AS titulo_corto,
  substr(COALESCE(observacion, ''), 1, 15) AS observacion_corto, {_missing('id_envio', '-')}, {_missing('n_flete', '-')}
FROM ({_fact_page_sql(1, 50, tags=False)})"""
SQL["trip_table_labels"] = f"""SELECT *, substr(COALESCE(cliente_final, ''), 1, 25) AS cliente_corto,
  {', '.join(_missing(c, '-') for c in ('origen', 'destino', 'zona', 'placa', 'estado_viaje'))}
FROM ({SQL['trip_table']})"""
SQL["trips_due_soon_labels"] = f"""SELECT *, CASE WHEN destino_carga IS NULL OR destino_carga = '' THEN destino
  ELSE destino_carga END AS destino_texto FROM ({SQL['trips_due_soon']})"""


def _operations_panels_sql() -> str:
    from cargoscope.operators.facets import OPERATIONS_PANELS
    parts = [f"SELECT '{g}' AS grupo, {c} AS nombre, COUNT(*) AS viajes, CAST(SUM(tarifa_final) AS DOUBLE) AS total "
             f"FROM billing WHERE {_blank(c, blanks)} GROUP BY {c}" for g, (c, blanks) in OPERATIONS_PANELS.items()]
    return with_roles("billing") + "\nUNION ALL ".join(parts)


SQL["operations_panels"] = _operations_panels_sql()


def _trip_panels_sql() -> str:
    bucket = ("CASE WHEN dias_retrazo IS NULL OR dias_retrazo <= 0 THEN 'A tiempo' "
              "WHEN dias_retrazo BETWEEN 1 AND 3 THEN '1-3 días' WHEN dias_retrazo BETWEEN 4 AND 7 THEN '4-7 días' "
              "ELSE '+7 días' END")
    parts = [f"SELECT '{g}' AS grupo, {e} AS nombre, COUNT(*) AS cantidad, "
             f"{avg6('porcentaje_cumplimiento', 1)} AS cumpl, MIN(COALESCE(dias_retrazo, 0)) AS orden "
             f"FROM trips WHERE {w} GROUP BY {e}"
             for g, e, w in (("zona", "zona", _blank("zona", "drop_blank")),
                             ("departamento", "departamento", _blank("departamento", "drop_blank")),
                             ("rango", bucket, "TRUE"))]
    return with_roles("trips") + "\nUNION ALL ".join(parts)


SQL["trip_panels"] = _trip_panels_sql()


def _executive_items() -> list[str]:
    return [
        "COUNT(*) AS total_viajes", f"{dbl(msum())} AS total_tarifa", f"{mavg()} AS tarifa_prom",
        "COUNT(DISTINCT nombre_compania) AS companias",
        *block(BILLED, "fact_viajes", "fact_total", "pct_facturado"),
        *block(UNBILLED, "pend_viajes", "pend_total", "pct_sin_facturar"),
        *block(CANCELLED, "anul_viajes", "anul_total", "pct_anulado"),
        *block(COLLECTED, "cob_viajes", "cob_total", "pct_cobrado"),
        f"{cif(WITH_FLT)} AS con_flt", f"{cif(WITHOUT_FLT)} AS sin_flt", f"{cif(ACCEPTED)} AS env_aceptados",
        f"{cif(CONFIRMED)} AS conf_viajes", f"{cif(TO_CONFIRM)} AS por_confirmar",
    ]


def _commercial_panels_sql() -> str:
    items = sel(_executive_items())
    parts = [
        f"SELECT 'resumen' AS grupo, CAST(NULL AS VARCHAR) AS clave, {items} FROM billing",
        f"SELECT 'mes' AS grupo, {mk('fecha_creacion')} AS clave, {items} FROM billing "
        f"WHERE fecha_creacion IS NOT NULL GROUP BY {mk('fecha_creacion')}",
        f"SELECT 'compania' AS grupo, nombre_compania AS clave, {items} FROM billing "
        "WHERE nombre_compania IS NOT NULL GROUP BY nombre_compania",
        f"SELECT 'status_cont_aje' AS grupo, status_contabilidad_aje AS clave, {items} FROM billing "
        "WHERE status_contabilidad_aje IS NOT NULL AND status_contabilidad_aje <> '' GROUP BY status_contabilidad_aje",
    ]
    return with_roles("billing") + "\nUNION ALL ".join(parts)


SQL["commercial_panels"] = _commercial_panels_sql()

# The saved views hold what the views over all rows give.
for _view in ("monthly", "company", "carrier", "collection", "dispatch", "pending_top", "detail", "on_time"):
    SQL[f"saved_{_view}"] = SQL[f"view_{_view}"]
SQL["saved_kpis"] = SQL["billing_kpis"]
SQL["saved_kpis_range"] = _billing_kpis_sql(derived=False, where=fact_where(MONTH_RANGE_ARGS))
