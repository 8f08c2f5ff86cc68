"""TOP-2..4 by thresholds: the same list as summing every group, with few keys shuffled."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cargoscope.operators import threshold
from cargoscope.operators.topk import pending_top_bounded, pending_top_carrier, top_by_amount, top_groups_by_amount
from cargoscope.sources.roles import role
from tests import frames
from tests.conftest import SF01

GROUP = ["nombre_compania", "nombre_sucursal", "transportista"]


def table(spark, seed: int, n: int, keys: int, amounts):
    draw = random.Random(seed)
    rows = [{"nombre_compania": draw.choice([None, "", "A", "B"]), "nombre_sucursal": f"s{draw.randrange(keys)}",
             "transportista": draw.choice([None, "t"]), "tarifa_final": amounts(draw), "estado_contable": "Sin Facturar"} for _ in range(n)]
    return frames.billing(spark, rows)


AMOUNTS = {
    "mixed signs and nulls": lambda d: d.choice([None, Decimal(d.randint(-90_000, 90_000)) / 100]),
    "ties": lambda d: Decimal(d.choice([1, 1, 2])),
    "all negative": lambda d: Decimal(-d.randint(1, 500)),
    "all null": lambda d: None,
    "few heavy": lambda d: Decimal(d.choice([1] * 40 + [9_000])),
}


@pytest.mark.parametrize("cells", [None, 7])
@pytest.mark.parametrize("kind", sorted(AMOUNTS))
def test_the_list_equals_the_plain_one(spark, kind, cells):
    for seed, keys in ((1, 4), (2, 60)):
        df = table(spark, seed, 240, keys, AMOUNTS[kind])
        want = [tuple(r) for r in top_by_amount(df, GROUP, 5).collect()]
        for first, most in ((1, 2), (6, 48), (512, 4096)):
            got = top_groups_by_amount(df, GROUP, 5, first=first, most=most, cells=cells)
            assert [tuple(r) for r in got.collect()] == want, (kind, seed, first)


def test_empty_tables_and_wrong_types(spark):
    df = table(spark, 1, 3, 2, AMOUNTS["ties"])
    assert top_groups_by_amount(df.where("false"), GROUP, 5).collect() == []
    with pytest.raises(ValueError, match="depend on their order"):
        top_groups_by_amount(df.withColumn("tarifa_final", F.col("tarifa_final").cast("double")), GROUP, 5)
    with pytest.raises(ValueError, match=">= 1"):
        top_groups_by_amount(df, GROUP, 0)


def shuffled_rows(df) -> int:
    """Rows written to shuffles by the final plan (the exchanges' own metric), by running it."""
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ran = df.select("*")
        ran._jdf.queryExecution().toRdd().count()
        found, todo = 0, [ran._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName() == "Exchange":
                found += node.metrics().get("shuffleRecordsWritten").get().value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return found
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_only_the_keys_of_the_chosen_cells_are_shuffled(spark):
    billing = role(spark, SF01, "billing").where("estado_contable = 'Sin Facturar'")
    keys = billing.select(*GROUP).distinct().count()
    plain, few = top_by_amount(billing, GROUP, 15), top_groups_by_amount(billing, GROUP, 15)
    whole = role(spark, SF01, "billing")
    assert few.collect() == plain.collect() == pending_top_bounded(whole).collect() == pending_top_carrier(whole).collect()
    assert keys > 10 * threshold.FIRST_CELLS
    assert shuffled_rows(few) <= 8 * threshold.FIRST_CELLS < keys <= shuffled_rows(plain)
