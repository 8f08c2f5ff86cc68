"""FLT-1, FLT-3: files that equality filters skip.

* Rows are clustered inside each file, so a value of the clustering columns fills few row groups and pages; Parquet's
  statistics and page index then skip the rest. The folder column leads the order: a write by folder sorts each task's
  rows by folder, and the planner drops any other order that doesn't start with it.
* Lookup columns get Bloom filters. Parquet stores one per column and row group unless a dictionary already lists all of
  the chunk's values (then the dictionary answers), so columns of few values cost nothing. A filter has at most
  ``BLOOM_BYTES``; it is sized by the values it meets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

#: Most bytes of one Bloom filter (one column of one row group).
BLOOM_BYTES = 1024 * 1024


def write_skippable(frame: DataFrame, path: str, cluster: Sequence[str] = (), lookup: Sequence[str] = (),
                    folder: str | None = None, row_group_bytes: int | None = None, mode: str = "errorifexists",
                    finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write ``frame`` as Parquet, sorted inside each file by ``cluster``, with Bloom filters on ``lookup``.

    ``folder`` names the column of the folders, if any. Which rows share a file is the frame's partitioning; a hot value
    of a clustering column needs no shuffle, as it is only sorted inside the tasks that hold it. ``finish`` is a projection
    that keeps those columns and makes the others, so that a sort holds narrow rows.
    """
    finish = finish or (lambda sorted_rows: sorted_rows)
    unknown = ({*cluster, *([folder] if folder else [])} - set(frame.columns)) | (set(lookup) - set(finish(frame).columns))
    if unknown:
        raise ValueError(f"no such column(s): {sorted(unknown)}")
    if cluster:
        frame = frame.sortWithinPartitions(*[f"`{c}`" for c in dict.fromkeys([*([folder] if folder else []), *cluster])])
    writer = finish(frame).write.mode(mode).option("compression", "zstd")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    if lookup:
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.max.bytes", BLOOM_BYTES)
    for name in lookup:
        if name != folder:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    (writer.partitionBy(folder) if folder else writer).parquet(path)
