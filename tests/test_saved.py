"""SNK-3, SNK-4, AGF-2, WIN-3: saved views from stored partials, version by version."""

from __future__ import annotations

import os
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from cargoscope.functions.predicates import month_range
from cargoscope.operators import kpis as K
from cargoscope.plans import registry
from cargoscope.plans.saved import COMPANIES, DETAIL, DICTIONARY, MONTH, SavedViews, _numbered
from cargoscope.plans.views import LABELS, VIEWS
from cargoscope.sinks.versions import VersionLog
from cargoscope.sources import roles as RL
from cargoscope.sources.tables import TABLE_NAMES, table
from tests.conftest import SF001


@pytest.fixture()
def source(spark, tmp_path):
    """A copy of the smallest tables; lineitem lacks the lines of orders from the first half of 1995."""
    late = table(spark, SF001, "orders").where("o_orderdate >= '1995-01-01' AND o_orderdate < '1995-07-01'").select("o_orderkey")
    for n in TABLE_NAMES[:7]:
        rows = table(spark, SF001, n)
        if n == "lineitem":
            rows.join(late, rows["l_orderkey"] == late["o_orderkey"], "left_anti").write.parquet(f"{tmp_path}/{n}.parquet")
        elif n == "orders":
            rows.write.parquet(f"{tmp_path}/{n}.parquet")
        else:
            os.symlink(f"{SF001}/{n}.parquet", f"{tmp_path}/{n}.parquet")
    return str(tmp_path)


def add_late_lines(spark, source):
    orders = table(spark, SF001, "orders").where("o_orderdate >= '1995-01-01' AND o_orderdate < '1995-07-01'").select("o_orderkey")
    lines = table(spark, SF001, "lineitem")
    lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"], "left_semi").coalesce(1).write.mode("append").parquet(f"{source}/lineitem.parquet")
    RL.refresh(spark, source)


def rows(df):
    return sorted(map(str, df.collect()))


def assert_whole(spark, views, source):
    billing = RL.role(spark, source, "billing")
    for name, build in VIEWS.items():
        got, want = views.view(name), build(billing)
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema], name
        assert rows(got) == rows(want), name
        if name != DETAIL:
            assert got.collect() == want.collect(), name          # the order, too
    assert rows(views.kpis()) == rows(K.billing_kpis(billing))
    for args in ({"mes_desde": "1995-03", "mes_hasta": "1996-02"}, {"mes_desde": "1997-01"}, {"mes_hasta": "1900-01"}):
        assert rows(views.kpis(**args)) == rows(K.billing_kpis(billing.where(month_range("fecha_creacion", **args)))), args


def test_added_lines_rewrite_only_their_months(spark, source, out_dir):
    views = SavedViews(spark, out_dir).refresh(source)
    assert_whole(spark, views, source)
    first = views.record
    assert views.refresh(source).record == first and len(os.listdir(f"{out_dir}/v1/versions")) == 2      # a file and its checksum
    reader = SavedViews(spark, out_dir).open()
    before = {n: rows(reader.view(n)) for n in VIEWS}
    held = {n: set(reader.stored(n).inputFiles()) for n in ("v_fact_compania", DETAIL, DICTIONARY)}
    add_late_lines(spark, source)
    views.refresh(source)
    assert_whole(spark, views, source)
    run = views.record["runs"][1]
    added = RL.read_parts(spark, source, "billing", views.record["parts"][1:])
    assert run["months"] == sorted(r[0] or "" for r in added.select(MONTH).distinct().collect())
    assert 0 < len(run["months"]) < len(first["runs"][0]["months"]) / 4
    for name in (*VIEWS, COMPANIES):
        found = {d for d in os.listdir(f"{out_dir}/v1/{name}/run={run['id']}") if d.startswith(MONTH)}
        assert found <= {f"{MONTH}={m or '__HIVE_DEFAULT_PARTITION__'}" for m in run["months"]} and found, name
    # The files written before are still those read for the other months.
    assert held["v_fact_compania"] < set(views.stored("v_fact_compania").inputFiles()) | held["v_fact_compania"]
    assert held[DETAIL] < set(views.stored(DETAIL).inputFiles())
    # A reader of the older version keeps its rows until it opens the log again.
    assert {n: rows(reader.view(n)) for n in VIEWS} == before
    assert rows(reader.open().view("v_fact_compania")) == rows(views.view("v_fact_compania")) != before["v_fact_compania"]


def test_a_month_is_written_again_with_its_stored_partials(spark, source, out_dir):
    """New lines of months that are stored already are added to them, and a company that is new gets the next number."""
    views = SavedViews(spark, out_dir).refresh(source)
    table(spark, SF001, "lineitem").where("l_orderkey % 50 = 7").coalesce(1).write.mode("append").parquet(f"{source}/lineitem.parquet")
    RL.refresh(spark, source)
    views.refresh(source)
    assert_whole(spark, views, source)
    ids = views.stored(DICTIONARY)
    assert ids.count() == ids.select("nombre_compania").distinct().count()
    assert sorted(r["id"] for r in ids.collect()) == list(range(1, ids.count() + 1))


def test_a_rebuilt_source_is_a_full_run_and_an_older_snapshot_takes_nothing_back(spark, source, out_dir):
    views = SavedViews(spark, out_dir).refresh(source)
    older = RL.snapshot(spark, source)
    table(spark, SF001, "orders").where("o_orderkey < 0").write.mode("append").parquet(f"{source}/orders.parquet")
    RL.refresh(spark, source)
    newer = views.refresh(source).record
    assert len(newer["runs"]) == 1 and newer["newest"] > max(p.rsplit("/", 1)[-1] for p in older.notes["parts", "billing"])
    key = next(k for k, v in RL._MEMO.items() if v is RL.snapshot(spark, source))
    kept, RL._MEMO[key] = RL._MEMO[key], older
    try:
        assert SavedViews(spark, out_dir).refresh(source).record == newer
    finally:
        RL._MEMO[key] = kept


def test_two_writers_leave_one_consistent_version(spark, source, out_dir):
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda _: SavedViews(spark, out_dir).refresh(source), range(2)))
    views = SavedViews(spark, out_dir).open()
    assert_whole(spark, views, source)
    assert len(views.record["runs"]) == 1


def test_another_process_reads_views_by_name_with_labels(spark, out_dir):
    views = SavedViews(spark, out_dir).refresh(SF001, labels={"tipo": "vista", "o'k": "ñ\\b"})
    again = SavedViews(spark, out_dir).refresh(SF001)                 # labels alone: a version without a new run
    assert again.record["runs"] == views.record["runs"] and again.labels() == LABELS
    code = ("import sys\nfrom cargoscope.session import build_session\nfrom cargoscope.plans.saved import SavedViews\n"
            "v = SavedViews(build_session(), sys.argv[1])\n"
            "v.register('x_')\n"
            "print(v.labels()['tipo'], len(v.names()), v.spark.sql('SELECT SUM(total_viajes) AS n FROM x_v_fact_compania').first().n)")
    done = subprocess.run([sys.executable, "-c", code, out_dir], capture_output=True, text=True, timeout=240)
    want = VIEWS["v_fact_compania"](RL.role(spark, SF001, "billing")).agg(F.sum("total_viajes").alias("n")).first().n
    assert done.stdout.split()[-3:] == [LABELS["tipo"], "8", str(want)], done.stderr[-2000:]
    with pytest.raises(KeyError):
        again.view("nowhere")
    with pytest.raises(FileNotFoundError):
        SavedViews(spark, f"{out_dir}/none").open()


def test_empty_tables_and_null_months(spark, tmp_path, out_dir):
    for n in TABLE_NAMES[:7]:
        t = table(spark, SF001, n)
        t = t.limit(0) if n == "lineitem" else t
        if n == "orders":
            t = t.withColumn("o_orderdate", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")))
        t.write.parquet(f"{tmp_path}/{n}.parquet")
    source = str(tmp_path)
    views = SavedViews(spark, out_dir).refresh(source)
    assert_whole(spark, views, source)
    assert views.view(DETAIL).count() == 0 and views.kpis().first()["companias"] == 0
    table(spark, SF001, "lineitem").where("l_orderkey % 2 = 0").coalesce(1).write.mode("append").parquet(f"{source}/lineitem.parquet")
    RL.refresh(spark, source)
    assert "" in views.refresh(source).record["runs"][-1]["months"]
    assert_whole(spark, views, source)
    table(spark, SF001, "lineitem").where("l_orderkey % 2 = 1").coalesce(1).write.mode("append").parquet(f"{source}/lineitem.parquet")
    RL.refresh(spark, source)
    assert_whole(spark, views.refresh(source), source)


def test_a_broken_version_is_passed_over(spark, out_dir):
    log = VersionLog(spark, f"{out_dir}/versions")
    assert log.latest() is None
    log.put("1", {"a": 1})
    log.put("2", {"a": "ñ"})
    with open(f"{out_dir}/versions/3.json", "w") as f:
        f.write('{"a": ')
    assert log.latest() == {"a": "ñ"}


def test_companies_are_numbered_without_a_gap(spark):
    names = spark.range(1000).select(F.concat(F.lit("c"), "id").alias("nombre_compania"))
    assert sorted(r["id"] for r in _numbered(names, F.lit(40)).collect()) == list(range(41, 1041))


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_latest_month_and_month_ranges_read_their_folders(spark):
    text = plan(registry.run(spark, "latest_month", SF001))
    folders = [ln for ln in text.splitlines() if ln.startswith("PartitionFilters")]
    assert folders and all("mes_creacion" in ln and " = " in ln for ln in folders)
    text = plan(registry.run(spark, "saved_kpis_range", SF001))
    folders = [ln for ln in text.splitlines() if ln.startswith("PartitionFilters")]
    assert len(folders) >= 2 and all("1996-03" in ln and "1997-02" in ln for ln in folders)
    assert "nombre_compania" not in text
