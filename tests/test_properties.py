"""Property tests: exact half-up rounding agrees across its three forms and with Decimal arithmetic."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cargoscope.functions import measures as M
from cargoscope.plans import oracle

# Keep the rounded value inside the exactly representable double range.
INTS = st.integers(min_value=-(10 ** 12), max_value=10 ** 12)
PAIRS = st.lists(st.tuples(INTS, INTS), min_size=1, max_size=200)


def expected(n: int, d: int, dp: int):
    if d == 0:
        return None
    q = (Decimal(n) / Decimal(d)).quantize(Decimal(1).scaleb(-dp), rounding=ROUND_HALF_UP)
    return float(q)


@settings(max_examples=6, deadline=None, derandomize=True)
@given(pairs=PAIRS, dp=st.integers(min_value=0, max_value=3))
def test_rounding_forms_agree(spark, pairs, dp):
    df = spark.createDataFrame(pairs, "n long, d long")
    got = df.select("n", "d", M.ratio_half_up(F.col("n"), F.col("d"), dp).alias("col_form"),
                    F.expr(M.ratio_sql("n", "d", dp)).alias("sql_form")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE p (n BIGINT, d BIGINT)")
    con.executemany("INSERT INTO p VALUES (?, ?)", pairs)
    duck = dict(((n, d), r) for n, d, r in con.execute(f"SELECT n, d, {oracle.ratio('n', 'd', dp)} FROM p").fetchall())
    for r in got:
        want = expected(r["n"], r["d"], dp)
        assert r["col_form"] == want and r["sql_form"] == want, (r, want)
        assert duck[(r["n"], r["d"])] == want


@settings(max_examples=4, deadline=None, derandomize=True)
@given(amounts=st.lists(st.one_of(st.none(), st.integers(min_value=0, max_value=10 ** 9)), min_size=1, max_size=60))
def test_money_average_is_exact_half_up(spark, amounts):
    from cargoscope.operators import kpis as K
    from tests import frames as FR
    rows = [{"tarifa_final": None if a is None else Decimal(a).scaleb(-2)} for a in amounts]
    got = K.validation_kpis(FR.billing(spark, rows)).first()["tarifa_prom"]
    present = [Decimal(a).scaleb(-2) for a in amounts if a is not None]
    want = None if not present else float(
        (sum(present) / len(present)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))
    assert got == want
