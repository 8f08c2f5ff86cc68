"""Plan checks: pushdown, pruning, one scan, top-k, no Python UDF anywhere."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import queries
from cargoscope.plans import registry
from tests.conftest import SF001


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def scans(text: str) -> int:
    return len(re.findall(r"^\(\d+\) Scan parquet", text, flags=re.M))


def test_month_range_reaches_the_scan(spark):
    text = formatted(registry.run(spark, "fact_month_range", SF001))
    pushed = [ln for ln in text.splitlines() if "PushedFilters" in ln]
    assert any("GreaterThanOrEqual(fecha_creacion" in ln and "LessThan(fecha_creacion" in ln for ln in pushed)


def test_month_range_prunes_month_folders(spark):
    text = formatted(registry.run(spark, "fact_month_range", SF001))
    parts = [ln for ln in text.splitlines() if ln.startswith("PartitionFilters")]
    assert any("mes_creacion" in ln and ">=" in ln and "<=" in ln for ln in parts)


def test_scan_is_pruned_to_the_needed_columns(spark):
    text = formatted(registry.run(spark, "dist_approval", SF001))
    schemas = [ln for ln in text.splitlines() if ln.startswith("ReadSchema")]
    assert schemas and all("nro_factura" not in s and "titulo" not in s for s in schemas)


def test_status_panel_scans_once(spark):
    text = formatted(registry.run(spark, "status_panel", SF001))
    assert scans(text) == 1 and "Expand" in text
    union = formatted(registry.run(spark, "status_panel_union", SF001))
    assert scans(union) == 4


@pytest.mark.parametrize("name", ["operations_panels", "trip_panels", "commercial_panels"])
def test_category_panels_scan_once(spark, name):
    assert scans(formatted(registry.run(spark, name, SF001))) == 1


def test_facets_scan_once(spark):
    text = formatted(registry.run(spark, "fact_facets", SF001))
    assert scans(text) == 1


@pytest.mark.parametrize("name", ["top_companies", "pending_top", "trip_table", "trips_due_soon", "fact_page"])
def test_top_k_plans_as_take_ordered(spark, name):
    assert "TakeOrderedAndProject" in plan(registry.run(spark, name, SF001))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_python_udf_window_or_cross_join(spark, name):
    text = plan(queries()[name](spark, SF001))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF",
                 "Window", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def broadcast_subtrees(text: str) -> list[str]:
    """The text of every subtree rooted at a BroadcastExchange (by tree-drawing indentation)."""
    lines = text.splitlines()
    out = []
    for i, ln in enumerate(lines):
        if "BroadcastExchange" not in ln:
            continue
        depth = ln.index("BroadcastExchange")
        sub = [ln]
        for nxt in lines[i + 1:]:
            body = nxt.lstrip(" :|+-")
            if not body or len(nxt) - len(body) <= depth:
                break
            sub.append(nxt)
        out.append("\n".join(sub))
    return out


@pytest.mark.parametrize("name", ["billing", "trips"])
def test_fact_join_is_sort_merge_and_lineitem_never_broadcast(spark, name):
    from cargoscope.sources.roles import lazy_role
    from tests.conftest import SF01
    text = plan(lazy_role(spark, SF01, name))
    assert "SortMergeJoin" in text
    assert all("lineitem.parquet" not in sub for sub in broadcast_subtrees(text))
