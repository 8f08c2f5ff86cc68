"""op7: what grows with the corpus is never broadcast, however small its files look."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cargoscope.llm import mixing


def _documents(spark):
    text = F.repeat(F.lit("palabra "), (F.col("id") % 700).cast("int"))
    return spark.range(600).select(F.col("id").alias("doc_id"), text.alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))


def _broadcast_nodes(df):
    """The final plan's lines that join by broadcast, after running ``df``."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]


def test_slots_segments_and_documents_are_not_broadcast(spark, monkeypatch):
    seen, cut = [], mixing.cut

    def watched(df):
        if "slot" in df.columns:
            seen.extend(_broadcast_nodes(df))
            assert any("SortMergeJoin [number" in line and "index" in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines())
        return cut(df)

    monkeypatch.setattr(mixing, "cut", watched)
    out = mixing.mix(_documents(spark))
    # What is left to broadcast has a row per source, shard or bucket; those joins name no slot, block or document.
    grown = [line for line in [*seen, *_broadcast_nodes(out)] if re.search(r"Join \[number#\w+, (pass#\w+, index|block|at)#", line)]
    assert grown == []


def test_hints_leave_the_mix_as_it_was(spark):
    rows = mixing.mix(_documents(spark)).collect()
    assert len(rows) == 600 and {r["doc_id"] for r in rows} == set(range(600))
    by_source = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        target, taken = by_source.get(r["target"], (r["target"], 0))
        by_source[r["target"]] = (target, taken + r["taken"])
    assert all(abs(taken - target) <= 0.1 * target for target, taken in by_source.values())
