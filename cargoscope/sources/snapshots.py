"""SRC-1: pinned snapshots of the source files, and commits of the role tables made from them.

A :class:`Snapshot` lists the source files of an input folder once, by Spark, and holds on to what it saw: every panel
over it reads the same version and starts no listing job. ``refresh`` takes a new one.

A role table is a list of *parts* (folders of Parquet files) named by a *commit*. A commit is written after its parts,
as a table of the source files that they cover and then a line with the parts; readers take the newest complete commit,
so they see the old rows or the new ones. When a fact source only gained files, the new commit keeps the old parts and
adds one with the joins of the new files; any other change of the sources is a full build.

Only counts, digests and the parts of one commit (``MOST_PARTS`` at most) reach the driver; file lists stay in Spark.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoscope.sources.metadata import sibling
from cargoscope.sources.tables import table_path

#: Parts of a table before a change makes a full build instead of one more part.
MOST_PARTS = 16
#: New files that one part is made from; more of them are a full build.
MOST_NEW_FILES = 100_000


#: Source bytes for each shuffle partition of a build, and the most bytes of a split that a build reads: written rows are
#: some 14 to 32 bytes each in files, and up to 50 times that in a sort.
PARTITION_BYTES = 8 * 1024 * 1024
SPLIT_BYTES = 8 * 1024 * 1024


def new_name() -> str:
    """A name that sorts by time and is never used twice."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def list_files(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    """(source, path, length, modified) of the files of the named sources, as they are now."""
    out = None
    for name in names:
        files = spark.read.format("binaryFile").load(table_path(sf_dir, name))
        one = files.select(F.lit(name).alias("source"), "path", "length", F.col("modificationTime").cast("double").alias("modified"))
        out = one if out is None else out.unionByName(one)
    return out


def digests(files: DataFrame) -> dict[str, str]:
    """A digest per source: the number of files and two order-free sums over path, length and modification time."""
    each = F.xxhash64("path", "length", "modified")
    found = files.groupBy("source").agg(F.count("*").alias("n"), F.bit_xor(each).alias("x"), F.sum(each.cast("decimal(20,0)")).alias("s"))
    return {r["source"]: f"{r['n']}-{r['x']}-{r['s']}" for r in found.collect()}


class Snapshot:
    """The source files of an input folder as they were when this was taken."""

    def __init__(self, spark: SparkSession, sf_dir: str, sources: tuple[str, ...]) -> None:
        self.spark, self.sf_dir, self.sources = spark, sf_dir, sources
        self.roles: dict[str, DataFrame] = {}
        self.notes: dict[tuple, object] = {}
        self._files: DataFrame | None = None
        self._digests: dict[str, str] | None = None
        self._builder: SparkSession | None = None

    def files(self, names: tuple[str, ...]) -> DataFrame:
        if self._files is None:
            self._files = list_files(self.spark, self.sf_dir, self.sources)
        return self._files.where(F.col("source").isin(*names))

    def version(self, names: tuple[str, ...]) -> dict[str, str]:
        """The digests of the named sources; listed once."""
        if self._digests is None:
            self._digests = digests(self.files(self.sources))
        return {n: self._digests.get(n, "") for n in names}

    def bytes(self) -> int:
        """The size of all source files."""
        return self.note(("bytes",), lambda: self.files(self.sources).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])

    def builder(self) -> SparkSession:
        """The session in which tables are made from the source files: this one, or for larger inputs a sibling.

        A number of shuffle partitions fixed by the session makes each of them, and the memory of the task that sorts it,
        grow with the input, until sorts spill. The sibling has partitions by the size of the input (AQE joins those that
        turn out small) and splits of bounded size; its other settings are the session's.
        """
        wanted = -(-self.bytes() // PARTITION_BYTES)
        if wanted <= int(self.spark.conf.get("spark.sql.shuffle.partitions")) and self.bytes() <= SPLIT_BYTES * 8:
            return self.spark
        if self._builder is None:
            self._builder = sibling(self.spark)
            partitions = max(wanted, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            self._builder.conf.set("spark.sql.shuffle.partitions", partitions)
            split = self.spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
                self.spark.conf.get("spark.sql.files.maxPartitionBytes"))
            self._builder.conf.set("spark.sql.files.maxPartitionBytes", min(split, SPLIT_BYTES))
        return self._builder

    def check_unchanged(self, names: tuple[str, ...]) -> None:
        """An error if the named sources changed since this was taken.

        Called between listing the files that a build reads and reading them, it makes sure that the part holds just
        the files which its commit names.
        """
        if digests(list_files(self.spark, self.sf_dir, names)) != {n: d for n, d in self.version(names).items() if d}:
            raise RuntimeError(f"the files of {', '.join(names)} changed during the build; take a new snapshot with refresh()")

    def note(self, key: tuple, make: Callable[[], object]):
        """A small fact about this snapshot (a page directory, say), found once."""
        if key not in self.notes:
            self.notes[key] = make()
        return self.notes[key]


class Commits:
    """The commits of one role table below ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def latest(self) -> dict | None:
        """The newest complete commit: its parts, the sources' digests and where its covered files are listed.

        The Hadoop file system API is used, so the same code works on HDFS and object stores.
        """
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits/*/record/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        if not found:
            return None
        newest = max(str(f.getPath().getParent().toString()) for f in found)
        return json.loads(self.spark.read.text(newest).first()["value"])

    def new_part(self) -> str:
        """A part is a folder ``part=...`` below the table, so that several are read by one scan."""
        return f"{self.root}/parts/part={new_name()}"

    def commit(self, parts: list[str], version: dict[str, str], files: DataFrame, made_from: list[str]) -> dict:
        """Make ``parts`` the table; ``made_from`` names the parts of another table that they were made from.

        The record is written last, by Spark's own commit: without it nothing shows.
        """
        folder = f"{self.root}/commits/{new_name()}"
        files.write.parquet(f"{folder}/covered")
        record = {"parts": parts, "version": version, "made_from": made_from, "covered": f"{folder}/covered"}
        self.spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.text(f"{folder}/record")
        return record


def added_files(spark: SparkSession, record: dict, now: DataFrame, version: dict[str, str], facts: tuple[str, ...]) -> dict[str, list[str]] | None:
    """Files per fact source that ``record`` doesn't cover, or None if a full build is needed: another source changed,
    or a covered file is gone or was written again."""
    changed = {n for n in version if record["version"].get(n) != version[n]}
    if not changed or not changed <= set(facts) or len(record["parts"]) >= MOST_PARTS:
        return None
    covered = spark.read.parquet(record["covered"]).where(F.col("source").isin(*changed))
    keys = ["source", "path", "length", "modified"]
    here = now.where(F.col("source").isin(*changed)).select(*keys)
    if not covered.select(*keys).join(here, keys, "left_anti").isEmpty():
        return None
    new = here.join(covered.select(*keys), keys, "left_anti").select("source", "path").limit(MOST_NEW_FILES + 1).collect()
    if len(new) > MOST_NEW_FILES:
        return None
    return {n: sorted(r["path"] for r in new if r["source"] == n) for n in changed}

