"""SRC-1: read a named table from a scale-factor folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    """Where a table lies; unknown names are an error, never a guess."""
    if name not in TABLE_NAMES:
        raise KeyError(f"unknown table {name!r}; known: {', '.join(TABLE_NAMES)}")
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan of one table, over the files that are there now."""
    return spark.read.parquet(table_path(sf_dir, name))


def load_tables(spark: SparkSession, sf_dir: str, names=TABLE_NAMES) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}
