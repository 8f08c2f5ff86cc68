"""SRC-3 and the counts of AGG-1 from file metadata: aggregates that are answered by Parquet footers.

Spark's DataSource V2 Parquet reader can answer ``COUNT(*)`` (and ``MIN``/``MAX`` of numbers and dates) from the footers,
without reading a column. It is off by default and chosen per session, so the frames of such queries are made in a
sibling session of the same application; the caller's settings stay as they are.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_SIBLINGS: dict[str, SparkSession] = {}
# The last caller of each application's sibling, and the sessions made for callers that read by V2 themselves.
_CALLERS: dict[str, SparkSession] = {}
_ROW_SESSIONS: dict[tuple[str, int], SparkSession] = {}

_V1_LIST = "spark.sql.sources.useV1SourceList"
#: Settings that the sibling takes over from the caller, as they change results.
KEPT = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.shuffle.partitions")


def metadata_session(spark: SparkSession) -> SparkSession:
    """A session of the same application that pushes aggregates into Parquet footers; one an application."""
    found = _SIBLINGS.get(spark.sparkContext.applicationId)
    if found is None:
        found = _SIBLINGS[spark.sparkContext.applicationId] = spark.newSession()
        v1 = found.conf.get(_V1_LIST).split(",")
        found.conf.set(_V1_LIST, ",".join(s for s in v1 if s != "parquet"))
        found.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    for key in KEPT:
        found.conf.set(key, spark.conf.get(key))
    if spark is not found:
        _CALLERS[spark.sparkContext.applicationId] = spark
    return found


def row_session(spark: SparkSession) -> SparkSession:
    """The session that builds tables for ``spark``: its Parquet scans give each row its file and place.

    Only the V1 reader does, so a build must not run in the sibling above, whichever query comes first. That is the
    session itself, the sibling's caller, or a session with the same settings that reads Parquet by V1.
    """
    app = spark.sparkContext.applicationId
    for one in (spark, _CALLERS.get(app) if spark is _SIBLINGS.get(app) else None):
        if one is not None and _reads_rows(one):
            return one
    key = (app, spark._jsparkSession.hashCode())
    if key not in _ROW_SESSIONS:
        _ROW_SESSIONS[key] = sibling(spark)
    found = _ROW_SESSIONS[key]
    found.conf.set(_V1_LIST, ",".join([*filter(None, spark.conf.get(_V1_LIST).split(",")), "parquet"]))
    return found


def sibling(spark: SparkSession) -> SparkSession:
    """Another session of the same application with the settings that ``spark`` has now."""
    made = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if made.conf.isModifiable(name):
            made.conf.set(name, value)
    return made


def _reads_rows(spark: SparkSession) -> bool:
    return "parquet" in [s.strip().lower() for s in spark.conf.get(_V1_LIST).split(",")]
