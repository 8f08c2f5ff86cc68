"""A log of small records in a shared folder: what a name stands for, without a metastore.

Each version is one file of JSON, written once and never changed. Readers take the last complete one by name order, so
the record is the pointer that moves from the old rows to the new ones at once. A writer that dies leaves a file that
isn't complete JSON, which readers pass over. Names carry an order key first: of two writers at once, the one with
the higher key is read, whichever wrote last, and equal keys differ by a random ending.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class VersionLog:
    """The versions below ``root``; the Hadoop file system API is used, so it may lie on HDFS or an object store."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self.root = spark.sparkContext._jvm, root
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self._conf)

    def latest(self) -> dict | None:
        """The last complete version, or None."""
        pattern, fs = self._path("*.json")
        for path in sorted((str(f.getPath().toString()) for f in fs.globStatus(pattern) or ()), reverse=True):
            stream = fs.open(self._jvm.org.apache.hadoop.fs.Path(path))
            try:
                return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except json.JSONDecodeError:
                continue
            finally:
                stream.close()
        return None

    def put(self, order: str, record: dict) -> None:
        """Add a version. ``order`` decides which of several versions is the last."""
        path, fs = self._path(f"{order}.{uuid.uuid4().hex[:8]}.json")
        stream = fs.create(path, False)
        try:
            stream.write(json.dumps(record).encode())
        finally:
            stream.close()
