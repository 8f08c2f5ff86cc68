"""Sinks, saved views and the catalog helpers."""

from __future__ import annotations

import json
import os

import pytest

from cargoscope.plans.views import LABELS, VIEWS, create_views, publish_views
from cargoscope.plans import registry
from cargoscope.sinks.writers import export_detail, materialise, write_json
from cargoscope.sources.catalog import describe_columns, preview, schema_diff, table_counts
from cargoscope.sources.roles import role
from cargoscope.sources.tables import table
from cargoscope.operators import rollups as R
from tests.conftest import SF001


def test_write_json_round_trip_with_iso_dates(spark, out_dir):
    df = registry.QUERIES["trips_due_soon"](spark, SF001)
    path = os.path.join(out_dir, "due")
    write_json(df, path)
    back = spark.read.json(path)
    assert back.count() == df.count()
    files = [f for f in os.listdir(path) if f.endswith(".json")]
    first = json.loads(open(os.path.join(path, files[0])).readline())
    assert "T" in first["fecha_carga"]


def test_export_detail_csv_is_whole_and_sorted(spark, out_dir):
    b = role(spark, SF001, "billing")
    path = os.path.join(out_dir, "export")
    export_detail(b, path, fmt="csv")
    back = spark.read.option("header", True).csv(path)
    assert back.count() == b.count()
    assert "compania" in back.columns and "sucursal" in back.columns and "fecha_creacion" not in back.columns
    with pytest.raises(ValueError):
        export_detail(b, path, fmt="xlsx")


def test_materialise_partitions_by_month(spark, out_dir):
    df = R.view_monthly(role(spark, SF001, "validated"))
    path = os.path.join(out_dir, "mensual")
    materialise(df, path, partition_by="mes")
    assert any(d.startswith("mes=") for d in os.listdir(path))
    assert spark.read.parquet(path).count() == df.count()


def test_create_views_registers_all_eight(spark):
    names = create_views(spark, role(spark, SF001, "validated"), prefix="t_")
    assert len(names) == 8 == len(VIEWS)
    for n in names:
        assert spark.table(n).count() > 0
    assert spark.sql("SELECT COUNT(*) FROM t_v_pendientes_top").first()[0] == 20
    with pytest.raises(ValueError):
        create_views(spark, role(spark, SF001, "validated"), scope="nowhere")


def test_preview_rejects_unknown_tables(spark):
    tables = {"orders": role(spark, SF001, "orders")}
    assert preview(tables, "orders", 3).count() == 3
    with pytest.raises(KeyError):
        preview(tables, "secret_table")


def test_table_counts_and_schema_diff(spark):
    counts = {r["nombre"]: r["filas"] for r in table_counts({"o": table(spark, SF001, "orders"),
                                                             "n": table(spark, SF001, "nation")}).collect()}
    assert counts["n"] == 25
    a = describe_columns(spark, table(spark, SF001, "documents"), "documents")
    b = describe_columns(spark, table(spark, SF001, "labels"), "labels")
    assert [r["column_name"] for r in schema_diff(a, b).collect()] == ["lang", "n_chars", "source", "text"]


def test_unknown_table_name_is_an_error(spark):
    with pytest.raises(KeyError):
        table(spark, SF001, "not_a_table")


def test_global_views_are_visible_to_other_sessions(spark):
    names = create_views(spark, role(spark, SF001, "validated"), prefix="g_", scope="global")
    other = spark.newSession()
    assert other.table(f"global_temp.{names[0]}").count() >= 1
    assert other.sql("SELECT COUNT(*) FROM global_temp.g_v_fact_compania").first()[0] > 0


def test_published_views_carry_labels_and_are_replaced_at_once(spark, out_dir):
    validated = role(spark, SF001, "validated")
    with pytest.raises(ValueError):                       # the test session's catalog ends with the session
        publish_views(spark, validated, out_dir)
    first = publish_views(spark, validated, out_dir, prefix="p_", persistent_only=False)
    assert set(first) == {f"p_{n}" for n in VIEWS}
    for name, path in first.items():
        want = VIEWS[name[2:]](validated)
        assert spark.table(name).columns == want.columns
        assert spark.table(name).count() == want.count() > 0, name
        shown = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        assert LABELS.items() <= shown.items()
    again = publish_views(spark, validated.limit(0), out_dir, prefix="p_", labels={"o'k": "a\\b"}, persistent_only=False)
    assert set(again) == set(first) and not set(again.values()) & set(first.values())
    assert spark.table("p_v_fletes_detalle").count() == 0
    assert spark.read.parquet(first["p_v_fletes_detalle"]).count() > 0    # readers of the older rows keep them
    shown = {r["key"]: r["value"] for r in spark.sql("SHOW TBLPROPERTIES p_v_fletes_detalle").collect()}
    assert shown["o'k"] == "a\\b"
    for name in first:
        spark.sql(f"DROP VIEW {name}")
