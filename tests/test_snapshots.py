"""SRC-1: pinned snapshots, added parts, one join for billing and trips."""

from __future__ import annotations

import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from cargoscope.plans import oracle, registry
from cargoscope.session import checkpoint_dir
from cargoscope.sources import roles as RL
from cargoscope.sources.tables import TABLE_NAMES, table
from tests.conftest import SF001
from tests.oracle_check import digest

ROLES = ("billing", "trips", "dispatch")


@pytest.fixture()
def source(spark, tmp_path):
    """A copy of the smallest tables; lineitem holds all lines but those of every third order."""
    for n in TABLE_NAMES[:7]:
        rows = table(spark, SF001, n)
        (rows.where("l_orderkey % 3 <> 0") if n == "lineitem" else rows).write.parquet(f"{tmp_path}/{n}.parquet")
    return str(tmp_path)


def rows(df):
    return sorted(map(str, df.collect()))


def jobs(spark, run):
    """The jobs that ``run`` starts."""
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return list(sc.statusTracker().getJobIdsForGroup("counted"))


def test_a_known_snapshot_starts_no_job(spark, source):
    for name in ROLES:
        RL.role(spark, source, name)
    assert jobs(spark, lambda: [RL.role(spark, source, n) for n in ("billing", "trips", "dispatch", "freight", "validated")]) == []
    assert jobs(spark, lambda: registry.QUERIES["billing_kpis"](spark, source)) == []
    assert len(jobs(spark, lambda: RL.refresh(spark, source).version(("lineitem",)))) >= 1


def test_added_lines_are_joined_alone_and_seen_everywhere(spark, source):
    counts = lambda: {r["nombre"]: r["filas"] for r in registry.run(spark, "table_counts", source).collect()}
    before = {n: RL.role(spark, source, n) for n in ROLES}
    held = {n: set(df.inputFiles()) for n, df in before.items()}
    size = {n: df.count() for n, df in before.items()}
    assert counts()["trips"] == size["trips"]
    table(spark, SF001, "lineitem").where("l_orderkey % 3 = 0").coalesce(1).write.mode("append").parquet(f"{source}/lineitem.parquet")
    assert {n: RL.role(spark, source, n).count() for n in ROLES} == size      # pinned
    RL.refresh(spark, source)
    for n in ROLES:
        now = RL.role(spark, source, n)
        assert rows(now) == rows(RL.lazy_role(spark, source, n)), n
        assert held[n] < set(now.inputFiles()), n                             # the old files stay, a part is added
        added = spark.read.parquet(*sorted(set(now.inputFiles()) - held[n])).count()
        assert added == now.count() - size[n] > 0, n
    assert counts()["trips"] == RL.role(spark, source, "trips").count()
    code = ("import sys\nfrom cargoscope.session import build_session\nfrom cargoscope.plans import registry\n"
            "s = build_session(extra={'spark.checkpoint.dir': sys.argv[2]})\n"
            "print({r['nombre']: r['filas'] for r in registry.run(s, 'table_counts', sys.argv[1]).collect()}['trips'])")
    done = subprocess.run([sys.executable, "-c", code, source, checkpoint_dir(spark)], capture_output=True, text=True, timeout=240)
    assert done.stdout.split()[-1:] == [str(counts()["trips"])], done.stderr[-2000:]


def test_other_changes_are_a_full_build(spark, source):
    held = set(RL.role(spark, source, "trips").inputFiles())
    table(spark, SF001, "supplier").limit(0).write.mode("append").parquet(f"{source}/supplier.parquet")
    table(spark, SF001, "orders").where("o_orderkey < 0").write.mode("append").parquet(f"{source}/orders.parquet")
    RL.refresh(spark, source)
    now = RL.role(spark, source, "trips")
    assert not held & set(now.inputFiles())
    assert rows(now) == rows(RL.lazy_role(spark, source, "trips"))


def test_billing_and_trips_share_one_join_of_lines_and_orders(spark):
    """The builds read the written lines: of the four plans only one joins lineitem with orders."""
    t = {n: table(spark, SF001, n) for n in RL.WRITTEN_SOURCES}
    lines = RL.read_parts(spark, SF001, RL.LINE_ORDERS, RL.ensure(RL.snapshot(spark, SF001), RL.LINE_ORDERS, checkpoint_dir(spark))["parts"])
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    joined = text(RL.build_line_orders(t))
    assert joined.count("orders.parquet") == joined.count("lineitem.parquet") == 1 and "SortMergeJoin" in joined
    for name in RL.FROM_LINES:
        plan = text(RL.BUILDERS[name][0](t | {RL.LINE_ORDERS: lines}))
        assert "orders.parquet" not in plan and "lineitem.parquet" not in plan, name
    assert RL.POSITION in lines.columns and lines.where(F.col(RL.POSITION).isNull()).count() == 0


def test_counts_come_from_file_metadata(spark):
    from cargoscope.sources.metadata import metadata_session

    def text(df):
        return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    counts = text(registry.run(spark, "table_counts", SF001))
    assert counts.count("PushedAggregation: [COUNT(*)]") == 6
    assert text(registry.run(spark, "home_summary", SF001)).count("PushedAggregation: [COUNT(*)]") == 4
    dates = RL.role(metadata_session(spark), SF001, "trips").agg(F.min("compromiso_de_carga"), F.max("compromiso_de_carga"))
    assert "PushedAggregation: [MIN(compromiso_de_carga), MAX(compromiso_de_carga)]" in text(dates)
    assert tuple(dates.first()) == tuple(RL.role(spark, SF001, "trips").agg(F.min("compromiso_de_carga"), F.max("compromiso_de_carga")).first())
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


@pytest.mark.parametrize("first", ["table_counts", "home_summary"])
def test_a_metadata_query_may_come_first(spark, source, first):
    """Its sibling session has no row places, so it must not be the one that builds the tables."""
    assert registry.run(spark, first, source).count() >= 1
    assert RL.snapshot(spark, source).spark is spark
    assert registry.run(spark, "fact_month_range", source).count() >= 1
    assert registry.run(spark, "trip_kpis", source).count() == 1


def test_a_caller_that_reads_parquet_by_v2_can_build(spark, source):
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "csv,json")
    own.conf.set("spark.sql.shuffle.partitions", "5")
    assert rows(RL.role(own, source, "trips")) == rows(RL.role(spark, source, "trips", written=False))
    assert RL.snapshot(own, source).spark.conf.get("spark.sql.shuffle.partitions") == "5"
    assert own.conf.get("spark.sql.sources.useV1SourceList") == "csv,json"


def test_builds_of_larger_inputs_have_partitions_by_size(spark, source, monkeypatch):
    """A fixed number of shuffle partitions makes tasks, their sorts and their spills grow with the input."""
    from cargoscope.sources import snapshots

    monkeypatch.setattr(snapshots, "PARTITION_BYTES", 2048)
    monkeypatch.setattr(snapshots, "SPLIT_BYTES", 16 * 1024)
    before = dict(spark.conf.getAll)
    seen = RL.refresh(spark, source)
    partitions = int(seen.builder().conf.get("spark.sql.shuffle.partitions"))
    assert partitions == -(-seen.bytes() // 2048) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert int(seen.builder().conf.get("spark.sql.files.maxPartitionBytes").rstrip("b")) == 16 * 1024
    for name in ROLES:
        assert rows(RL.role(spark, source, name)) == rows(RL.role(spark, source, name, written=False))
    assert registry.run(spark, "saved_carrier", source).count() >= 1
    assert dict(spark.conf.getAll) == before


def test_the_range_shuffle_of_billing_carries_each_value_once(spark, source):
    """The mapping repeats names, types and keys as text; it comes after the shuffle and the sort."""
    t = {n: table(spark, source, n) for n in RL.BUILDERS["billing"][1]}
    held, mapped = RL.billing_rows(t), RL.build_billing(t)
    text = lambda df: [c for c, kind in df.dtypes if kind == "string"]
    assert len(text(held)) <= 12 < len(text(mapped))
    assert rows(RL.map_billing(RL.billing_keys(held.repartitionByRange(5, "fecha_creacion", "l_orderkey")))) == rows(mapped)


def test_queries_after_a_metadata_query_equal_their_sql(spark, tmp_path):
    """Queries of a process that counts from file metadata first: each must still find tables built with row places."""
    for n in TABLE_NAMES[:7]:
        table(spark, SF001, n).coalesce(1).write.parquet(f"{tmp_path}/{n}.parquet")
    con = duckdb.connect()
    for n in TABLE_NAMES[:7]:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{tmp_path}/{n}.parquet/*.parquet')")
    assert registry.run(spark, "table_counts", str(tmp_path)).count() >= 1
    for name in ("fact_month_range", "panel_table_filtered", "panel_ranking_filtered", "panel_dispatch_filtered", "trip_kpis",
                 "freight_kpis", "monthly_freight", "view_monthly", "monthly_pct_billed", "zone_compliance"):
        got = registry.run(spark, name, str(tmp_path))
        want = con.execute(oracle.SQL[name])
        names = [d[0] for d in want.description]
        made = digest([tuple(r[c] for c in sorted(names)) for r in got.collect()])
        at = [names.index(c) for c in sorted(names)]
        assert sorted(got.columns) == sorted(names) and made == digest([tuple(r[i] for i in at) for r in want.fetchall()]), name


def test_billing_shuffles_classes_of_values_that_are_only_compared(spark, source):
    """Quantities, sizes, states and arrivals go through the shuffles in one number; nulls are in the last class."""
    t = {n: table(spark, source, n) for n in RL.BUILDERS["billing"][1]}
    held = RL.billing_rows(t)
    assert not {"l_quantity", "p_size", "o_orderstatus", "estado_flt", "a_tiempo"} & set(held.columns) and len(held.columns) <= 16
    odd = spark.createDataFrame([(0, None), (1, 20.0), (2, 20.5), (3, 40.0), (4, 49.5), (5, 50.0)], "k long, q double")
    q = F.col("q")
    made = odd.withColumn(RL.CLASSES, RL._class(RL.FLT, q > 30) + RL._class(RL.QUANTITY, q <= 20, q <= 40, q < 50) + RL._class(RL.SIZE, q <= 20, q <= 40))
    classes = [[n for n in range(4) if r[n]] for r in made.orderBy("k").select(*[RL._is_class(RL.QUANTITY, n) for n in range(4)]).collect()]
    assert classes == [[3], [0], [1], [1], [2], [3]]
    assert [tuple(r) for r in made.orderBy("k").select(RL._is_class(RL.FLT, 0), RL._is_class(RL.SIZE, 2)).collect()] == [
        (False, True), (False, False), (False, False), (True, False), (True, True), (True, True)]


def packed_billing(t, lists):
    held = RL.billing_rows(t, lists).repartitionByRange(5, "fecha_creacion", "l_orderkey", RL.PLACE)
    return RL.map_billing(RL.billing_columns(RL.billing_keys(held, lists), lists))


def test_billing_shuffles_numbers_for_text_of_few_values(spark, source, monkeypatch):
    t = {n: table(spark, source, n) for n in RL.BUILDERS["billing"][1]}
    lists, mapped = RL.value_lists(t), rows(RL.build_billing(t))
    held = RL.billing_rows(t, lists)
    assert set(lists) == set(RL.CODED) and len(held.columns) <= 8
    assert [c for c, kind in held.dtypes if kind == "string"] == ["c_name", "transportista"]
    assert rows(packed_billing(t, lists)) == mapped
    # Columns of many or long values go as they are.
    monkeypatch.setattr(RL, "MOST_CODES", 7)
    few = RL.value_lists(t)
    assert "p_name" not in few and "nombre_compania" not in few and "l_returnflag" in few
    assert "p_name" in RL.billing_rows(t, few).columns and rows(packed_billing(t, few)) == mapped
    monkeypatch.setattr(RL, "MOST_CODED_LENGTH", 0)
    assert RL.value_lists(t) == {} and rows(packed_billing(t, {})) == mapped
    # A value that the lists lack is an error, not another value.
    with pytest.raises(Exception, match="a value of p_brand came up"):
        packed_billing(t, lists | {"p_brand": lists["p_brand"][1:]}).collect()


def test_billing_packs_any_line_number_and_missing_values(spark, source):
    t = {n: table(spark, source, n) for n in RL.BUILDERS["billing"][1]}
    odd = F.expr("CASE l_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN -l_linenumber WHEN 2 THEN 2147483647 WHEN 3 THEN -2147483648 ELSE 0 END")
    lineitem = RL._short_position(RL._positioned(t["lineitem"])).withColumns({
        "l_linenumber": odd.cast("int"), "l_returnflag": F.when(F.col("l_suppkey") % 2 == 0, F.col("l_returnflag")),
        "l_linestatus": F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(F.col("l_linestatus")), "l_quantity": F.when(F.col("l_suppkey") % 4 != 0, F.col("l_quantity"))})
    part = t["part"].withColumns({"p_brand": F.lit(None).cast("string"), "p_size": F.when(F.col("p_partkey") % 2 == 0, F.col("p_size"))})
    t |= {"lineitem": lineitem, "part": part}
    lists = RL.value_lists(t)
    assert lists["p_brand"] == [] and "" in lists["l_linestatus"]
    assert rows(packed_billing(t, lists)) == rows(RL.build_billing(t | {"lineitem": lineitem.drop(RL.POSITION)}))
    lines = t | {"lineitem": lineitem}
    flags = RL.flag_lists(lines)
    narrow, plain = RL.build_line_orders(lines, flags), RL.build_line_orders(lines)
    assert set(flags) == set(RL.CODED_FLAGS) and narrow.dtypes == plain.dtypes and rows(narrow) == rows(plain)
    assert rows(RL.build_line_orders(lines, {})) == rows(plain)
    joined = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" in joined  # what the join shuffles is the number, not its parts
