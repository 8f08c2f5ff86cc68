"""SNK-1, SNK-2, SNK-4: JSON records, the detail export, and materialised views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from cargoscope.functions.scalars import to_edge
from cargoscope.operators.detail import export_rows


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-1: JSON records with ISO dates and money as numbers."""
    to_edge(df).write.mode(mode).json(path)


def export_detail(billing: DataFrame, path: str, fmt: str = "csv", where: Column | None = None,
                  mode: str = "overwrite") -> None:
    """SNK-2: the whole filtered detail, newest first, written by the executors.

    The single in-memory workbook of the reference is re-aimed as a distributed
    write: the sort is a range-partitioned distributed sort, and part files are
    numbered in sort order.
    """
    rows = to_edge(export_rows(billing, where))
    writer = rows.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unsupported export format {fmt!r}")


def materialise(df: DataFrame, path: str, partition_by: str | None = "mes", mode: str = "overwrite") -> None:
    """SNK-4: write a view result for repeated reads, partitioned by month so month filters prune folders."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
