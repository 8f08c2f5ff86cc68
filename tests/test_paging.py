"""PAG-1: every row once by cursor, numbered pages at any depth, and what their plans read and keep."""

from __future__ import annotations

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cargoscope.operators import paging as PG
from cargoscope.operators.detail import NEWEST_FIRST, fact_detail, fact_page, fact_page_after, fact_pages, month_directory, next_fact_cursor
from cargoscope.operators.topk import sort_keys
from cargoscope.sources.roles import role
from tests.conftest import SF001

KEYS = [("day", "desc")]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def kept_rows(df) -> int:
    """The most rows that a task of the plan keeps for the order."""
    return max((int(n) for n in re.findall(r"(?:TakeOrderedAndProject\(limit=|(?:Global|Local|Collect)Limit )(\d+)", plan(df))), default=0)


def folders(df) -> set[str]:
    return set(re.findall(r"\d{4}-\d{2}(?!-)", " ".join(re.findall(r"PartitionFilters: \[.*?\], ", plan(df)))))


def table(spark, n=700):
    """Nulls in every column, ties, and a row with 150 copies."""
    rng = random.Random(4)
    rows = [(rng.choice([None, *(dt.datetime(2000, 1, 1 + d) for d in range(9))]), rng.choice([None, "a", "b", ""]),
             rng.choice([None, 1.5, -2.0, 0.25]), rng.choice([None, Decimal("1.10"), Decimal("-3.00")])) for _ in range(n)]
    rows += [(dt.datetime(2000, 1, 5), "copy", 0.0, None)] * 150 + [(None, None, None, None)] * 60
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "day timestamp_ntz, name string, x double, money decimal(18,2)").repartition(5)


def walked(df, size):
    shown, cursor = [], None
    while page := PG.page_after(df, KEYS, PG.Cursor.of_token(cursor.token()) if cursor else None, size).collect():
        assert len(page) <= size
        shown += page
        cursor = PG.next_cursor(page, df, KEYS, cursor)
    return shown


def test_stepping_gives_every_row_once(spark):
    """Copies are cut by a page's end, and more copies than two pages hold come in a row."""
    df = table(spark)
    assert walked(df, 70) == df.orderBy(*sort_keys(df, KEYS)).collect()


def test_stepping_through_the_billing_table(spark):
    b = role(spark, SF001, "billing")
    detail = fact_detail(b)
    whole = detail.orderBy(*sort_keys(detail, list(NEWEST_FIRST))).collect()
    shown, cursor, months = [], None, month_directory(b)
    while page := fact_page_after(b, cursor, 1500, directory=months).collect():
        shown += page
        cursor = next_fact_cursor(page, b, cursor)
    assert shown == whole
    stepped = fact_pages(b, 20, 50).collect()                       # 1,000 rows in pages of 50
    assert sorted(r["pagina"] for r in stepped) == [1 + i // 50 for i in range(1000)]
    by_page = [tuple(r)[:-1] for p in range(1, 21) for r in stepped if r["pagina"] == p]
    assert by_page == [tuple(r) for r in whole[:1000]]


def test_numbered_pages_equal_the_sorted_table(spark):
    skipped, pivots = 25, 8
    df = table(spark).cache()
    whole = df.orderBy(*sort_keys(df, KEYS)).collect()
    for offset, size in ((0, 10), (333, 25), (len(whole) - 3, 50), (len(whole) + 90, 5), (420, 300)):
        page = PG.located(df, KEYS, offset, size, skipped, pivots)
        assert page.collect() == whole[offset:offset + size], (offset, size)
        assert kept_rows(page) <= skipped + 2 * size
    df.unpersist()


def test_numbered_pages_of_the_billing_table(spark, monkeypatch):
    monkeypatch.setattr(PG.located, "__defaults__", (20, 8))
    b = role(spark, SF001, "billing")
    detail = fact_detail(b)
    whole = detail.orderBy(*sort_keys(detail, list(NEWEST_FIRST))).collect()
    months = month_directory(b)
    assert sum(n for _, n in months) == len(whole) and months[-1][0] is None
    for page_no in (1, 37, len(whole) // 50 + 1, len(whole) // 50 + 9):
        page = fact_page(b, page_no, 50, directory=months)
        want = whole[50 * (page_no - 1):50 * page_no]
        assert page.collect() == want, page_no
        assert kept_rows(page) <= 120
        if want:
            assert folders(page) == {r["fecha_creacion"].strftime("%Y-%m") for r in want if r["fecha_creacion"]}, page_no
    where = F.col("estado_flt") == "Con FLT"
    some = [r for r in whole if r["estado_flt"] == "Con FLT"]
    assert fact_page(b, 20, 50, where=where).collect() == some[950:1000]


def test_cursor_pages_read_a_few_months(spark):
    b = role(spark, SF001, "billing")
    months = month_directory(b)
    first = fact_page_after(b, None, 50, directory=months)
    assert folders(first) == {months[0][0]} or len(folders(first)) <= 3
    cursor = next_fact_cursor(first.collect(), b)
    page = fact_page_after(b, cursor, 50, directory=months)
    assert 1 <= len(folders(page)) <= 4 and kept_rows(page) <= 100
    pushed = re.findall(r"PushedFilters: \[.*", plan(page))
    assert any("LessThanOrEqual(fecha_creacion" in p for p in pushed)


def test_cursor_tokens_and_bad_arguments(spark):
    values = {"d": dt.datetime(2001, 2, 3, 4, 5, 6, 7), "e": dt.date(1999, 1, 1), "m": Decimal("1.50"), "t": "ñ\"", "n": None, "i": 3, "f": 0.1}
    assert PG.Cursor.of_token(PG.Cursor(values, 4).token()) == PG.Cursor(values, 4)
    with pytest.raises(TypeError):
        PG.Cursor({"b": b"x"}).token()
    df = spark.createDataFrame([(1, "a")], "day int, name string")
    with pytest.raises(ValueError):
        PG.page_after(df, KEYS, PG.Cursor({"name": "a"}), 5)
    with pytest.raises(ValueError):
        PG.page_after(df, KEYS, None, 0)
    assert PG.next_cursor([], df, KEYS) is None
    assert PG.numbered_page(df.limit(0), KEYS, 5000, 50).count() == 0
