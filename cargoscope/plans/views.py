"""SNK-3 and the eight saved reporting views (section 2.11 of the survey).

``plans/saved.py`` keeps the views' rows in a shared folder and brings them up to date; here they are named queries.

A view is an operator registered under a name: its logical plan is kept in the
catalog and runs only when read. ``createOrReplaceTempView`` replaces a view
atomically (the reference deletes, then creates), and any failure raises.
``ORDER BY`` inside a view is only a hint to later readers, who sort for
themselves.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from cargoscope.operators import distributions as D
from cargoscope.operators import rollups as R
from cargoscope.operators import scorecards as S
from cargoscope.operators import topk as TK
from cargoscope.operators.detail import view_detail
from cargoscope.sinks.writers import materialise


def _profile(dim: str) -> Callable[[DataFrame], DataFrame]:
    def build(validated: DataFrame) -> DataFrame:
        return D.amount_by(validated, dim, "drop_blank", with_avg=True,
                           names=("viajes", "total_tarifa", "tarifa_promedio"))
    return build


# The saved view names.
VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "v_fact_mensual": R.view_monthly,
    "v_fact_compania": S.view_company,
    "v_fact_transportista": S.view_carrier,
    "v_status_crisar": _profile("status_crisar"),
    "v_envio_factura": _profile("estado_envio_factura"),
    "v_pendientes_top": TK.view_pending_top,
    "v_fletes_detalle": view_detail,
    "v_on_time_resumen": R.view_on_time,
}


# Fixed value: the label of every saved view.
LABELS = {"tipo": "vista_datastudio"}


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def publish_views(spark: SparkSession, validated: DataFrame, base_path: str, prefix: str = "",
                  labels: Mapping[str, str] = LABELS, persistent_only: bool = True) -> dict[str, str]:
    """Saved views that outlive the application, with their labels as view properties; name -> path.

    Every result is written to a folder of its own below ``base_path`` (a shared
    folder), and ``CREATE OR REPLACE VIEW`` then moves the name to it, so readers
    see the old rows or the new ones and never a gap. Call it again to refresh.
    Older folders stay for readers that still use them. The detail view keeps its
    order by date, so row-group statistics skip data for a date filter. Without a
    persistent catalog (Hive) the call is an error, as the views would end with
    the session; ``persistent_only=False`` accepts that.
    """
    if persistent_only and spark.conf.get("spark.sql.catalogImplementation", "in-memory") != "hive":
        raise ValueError("saved views need a persistent catalog; create_views registers them for this session")
    properties = ", ".join(f"{_quoted(k)} = {_quoted(v)}" for k, v in labels.items())
    paths = {}
    for name, build in VIEWS.items():
        path = f"{base_path.rstrip('/')}/{name}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        materialise(build(validated), path, partition_by=None, mode="errorifexists")
        with_labels = f" TBLPROPERTIES ({properties})" if properties else ""
        spark.sql(f"CREATE OR REPLACE VIEW {prefix}{name}{with_labels} AS SELECT * FROM parquet.`{path}`")
        paths[f"{prefix}{name}"] = path
    return paths


def create_views(spark: SparkSession, validated: DataFrame, prefix: str = "", scope: str = "session") -> list[str]:
    """Register every saved view over ``validated``; returns the registered names.

    ``scope="global"`` registers them in ``global_temp`` so other sessions of the
    same application can read them.
    """
    names = []
    for name, build in VIEWS.items():
        df = build(validated)
        full = f"{prefix}{name}"
        if scope == "session":
            df.createOrReplaceTempView(full)
        elif scope == "global":
            df.createOrReplaceGlobalTempView(full)
        else:
            raise ValueError(f"scope must be 'session' or 'global', got {scope!r}")
        names.append(full)
    return names
