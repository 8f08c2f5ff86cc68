"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009..U+000D.
WORD_REGEX = "[^\\x20\\x09-\\x0D]+"
#: Rows handed to a per-row helper at a time, so that only a slice of a batch is held as Python objects.
SLICE_ROWS = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Only a local session (tests) may be without it; that session then gets a temporary folder of its own.
    """
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
    elif spark.sparkContext.master.startswith(("local[", "local")) and "cluster" not in spark.sparkContext.master:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-checkpoint-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.sparkContext.getCheckpointDir()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """Cut the lineage at a table written to the shared folder: losing an executor then costs a re-read, and the
    planner sees the table's real size instead of an estimate that grows with every join before it.

    ``files``: the most files that the table is written in, for tables that many shuffle partitions would leave in
    scraps. On a local or mounted folder Hadoop starts processes for the modes of each file and folder that a task makes.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, "table")
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows(batch: pa.RecordBatch, size: int = SLICE_ROWS) -> Iterator[list[dict]]:
    """The rows of an Arrow batch, a slice at a time."""
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size).to_pylist()


def per_row(schema: pa.Schema, fn_factory: Callable[[], Callable[[dict], Iterator[dict]]]):
    """A ``mapInArrow`` function from a per-row generator; ``fn_factory`` runs once per task (models, caches)."""

    def run(batches):
        fn = fn_factory()
        for batch in batches:
            for part in rows(batch):
                out = [made for row in part for made in fn(row)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def text_or_empty(column: str):
    return F.coalesce(F.col(column), F.lit(""))
