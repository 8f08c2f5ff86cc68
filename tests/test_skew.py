"""Skew: a date holding a large share of the rows must not land in one task."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargoscope.operators.detail import _skew_safe_order
from cargoscope.sources import roles as RL
from tests import frames as FR
from tests.conftest import SF001


def partition_sizes(df) -> list[int]:
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_tie_break_spreads_a_hot_date_over_range_partitions(spark):
    hot = FR.ts("2000-05-05")
    rows = [{"fecha_creacion": hot if i % 2 == 0 else FR.ts(f"2000-{1 + i % 12:02d}-{1 + i % 27:02d}"),
             "id_envio": f"{i:06d}"} for i in range(4000)]          # half of all rows share one date
    df = FR.billing(spark, rows)
    date_only = partition_sizes(df.repartitionByRange(16, "fecha_creacion"))
    with_tie = partition_sizes(df.repartitionByRange(16, "fecha_creacion", "id_envio"))
    assert max(date_only) >= 2000                                    # the hot date sits in one partition
    assert max(with_tie) < 1000                                      # the tie-break splits it
    ordered = df.orderBy(*_skew_safe_order("fecha_creacion", ["id_envio"]))
    assert ordered.first()["fecha_creacion"] is not None


def test_position_tie_break_spreads_a_group_of_copies(spark):
    copy = {"fecha_creacion": FR.ts("2000-05-05"), "id_envio": "same", "titulo": "same"}
    rows = [copy if i % 2 == 0 else {"fecha_creacion": FR.ts("2001-01-01"), "id_envio": f"{i:06d}"}
            for i in range(4000)]                                       # half of all rows are exact copies
    df = FR.billing(spark, rows).repartition(8)
    by_content = partition_sizes(df.repartitionByRange(16, "fecha_creacion", "id_envio", "titulo"))
    assert max(by_content) >= 2000                                     # content keys cannot split copies
    keys = _skew_safe_order("fecha_creacion", ["id_envio"])
    # explicit partition count: small test data would otherwise be coalesced by AQE into one partition
    assert max(partition_sizes(df.repartitionByRange(16, *keys))) < 1000   # the position key does
    safe = df.orderBy(*keys)
    assert safe.count() == 4000 and safe.first()["fecha_creacion"] == FR.ts("2001-01-01")


def test_write_position_is_fixed_by_the_source_files(spark):
    def keys(shuffle_partitions):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffle_partitions)
        try:
            rows = RL.positioned_role(spark, SF001, "billing").select("id_envio", RL.POSITION).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        return sorted((r[0], tuple(r[1])) for r in rows)

    some = keys(3)
    assert some == keys(11)                                             # not by how the joins were dealt
    assert len({place for _, place in some}) == len(some)
    assert RL.POSITION not in RL.role(spark, SF001, "billing").columns
    assert RL.role(spark, SF001, "billing").count() == len(some)
