"""FLT-1, FLT-3: clustered files and Bloom filters let equality filters skip rows; results stay the same."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cargoscope.functions.predicates import fact_filter
from cargoscope.sinks.layout import write_skippable
from cargoscope.sources import roles
from tests.conftest import SF001

ROWS = 200_000


def rows_read(df) -> int:
    """Rows that the scan of ``df`` gave after skipping (its own metric), by running it."""
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ran = df.select("*")
        ran._jdf.queryExecution().toRdd().count()
        leaf = ran._jdf.queryExecution().executedPlan().collectLeaves().head()
        return leaf.metrics().get("numOutputRows").get().value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@pytest.fixture(scope="module")
def fact(spark):
    """One month and the next: 40 companies in no order, a code that nearly every row has alone, one rare company."""
    n = F.col("id")
    company = F.when(n % 7 != 0, F.concat(F.lit("company "), F.lpad((F.xxhash64(n) % 20 + 20).cast("string"), 2, "0")))
    return spark.range(ROWS, numPartitions=2).select(
        F.when(n == 4321, "company 07b").otherwise(company).alias("company"),
        F.concat(F.lit("code "), F.sha2(n.cast("string"), 256)).alias("code"),
        F.when(n % 2 == 0, "2024-01").otherwise("2024-02").alias("month"),
        n.alias("row"),
    )


@pytest.fixture(scope="module")
def written(spark, fact, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "fact")
    write_skippable(fact, path, ["company", "row"], ["company", "code"], "month", row_group_bytes=256 * 1024)
    return path


def same_rows(a, b) -> bool:
    cols = ["company", "code", "month", "row"]
    return sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_files_are_clustered_and_have_many_row_groups(written):
    files = glob.glob(f"{written}/month=*/*.parquet")
    assert files and max(pq.ParquetFile(f).num_row_groups for f in files) > 4
    for f in files:
        rows = pq.ParquetFile(f).read(columns=["company", "row"]).to_pylist()
        assert (keys := [(r["company"] is not None, r["company"] or "", r["row"]) for r in rows]) == sorted(keys)


@pytest.mark.parametrize("value, share", [("company 07b", 0.2), ("company 25", 0.5), ("company 07c", 0.2), ("zzz", 0.0)])
def test_a_company_reads_a_part_of_the_rows(spark, fact, written, value, share):
    got = spark.read.parquet(written).where(F.col("company") == value)
    assert rows_read(got) <= share * ROWS
    assert same_rows(got, fact.where(F.col("company") == value))


def test_an_absent_or_single_code_is_skipped_by_bloom_filters_alone(spark, fact, written, tmp_path):
    plain = str(tmp_path / "plain")
    write_skippable(fact, plain, ["company", "row"], [], "month", row_group_bytes=256 * 1024)
    present = fact.where("row = 777").first()["code"]
    for value, most in (("code 0123absent", 0), (present, ROWS // 10)):
        found, scanned = (spark.read.parquet(p).where(F.col("code") == value) for p in (written, plain))
        # The code lies between the least and the greatest one of nearly every row group: only Bloom filters tell.
        assert rows_read(found) <= most < rows_read(scanned)
        assert same_rows(found, scanned) and found.count() == (value == present)


def test_unknown_columns_are_an_error(fact, tmp_path):
    with pytest.raises(ValueError, match="no such column"):
        write_skippable(fact, str(tmp_path / "x"), ["nothing"])


def test_an_empty_table_and_clashing_names(spark, fact, tmp_path):
    path = str(tmp_path / "empty")
    write_skippable(fact.where("false").withColumn("parquet.block.size", F.lit(1)), path, ["company"], ["code"], row_group_bytes=4096)
    assert spark.read.schema(fact.schema).parquet(path).count() == 0


def test_the_written_billing_table_keeps_its_order_inside_files(spark):
    roles.role(spark, SF001, "billing")
    _, cluster, folder = roles.MATERIALISED["billing"]
    files = [f for part in roles.parts(spark, SF001, "billing") for f in glob.glob(f"{part.removeprefix('file:')}/{folder}=*/*.parquet")]
    assert files
    for f in files:
        rows = pq.ParquetFile(f).read(columns=list(cluster)).to_pylist()
        keys = [tuple((r[c] is not None, str(r[c])) for c in cluster) for r in rows]
        assert keys == sorted(keys)


def test_filters_of_the_written_table_give_the_rows_of_the_joins(spark):
    args = {"compania": "NATION_7", "estado_contable": "Facturado", "mes_desde": "1995-01", "mes_hasta": "1997-12"}
    written, lazy = roles.role(spark, SF001, "billing"), roles.lazy_role(spark, SF001, "billing")
    cols = ["id_envio", "tarifa_final", "fecha_creacion"]
    got = written.where(fact_filter(month_col="mes_creacion", **args)).select(cols).collect()
    assert got and sorted(map(str, got)) == sorted(map(str, lazy.where(fact_filter(**args)).select(cols).collect()))
