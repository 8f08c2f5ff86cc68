"""Session settings shared by the library entry points, the tests and bench.py."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every query in this library assumes: UTC month keys, ANSI arithmetic
# (division by zero raises, so shares use guarded forms), and adaptive execution
# so that shuffle partition counts, join strategies and skewed partitions are
# re-planned from runtime statistics.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str = "local[8]",
    shuffle_partitions: int = 8,
    app_name: str = "cargoscope",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``, or None.

    The library only ever writes derived tables below this folder. It never
    invents a machine-local folder; tests and bench.py set one when unset.
    """
    value = spark.conf.get("spark.checkpoint.dir", None)
    if value:
        return value.rstrip("/")
    try:
        value = spark.sparkContext.getCheckpointDir()
    except Exception:  # noqa: BLE001 - not available in every deployment mode
        value = None
    return value.rstrip("/") if value else None


def can_checkpoint(spark: SparkSession) -> bool:
    """True when ``DataFrame.checkpoint()`` has a reliable folder to write to."""
    try:
        return bool(spark.sparkContext.getCheckpointDir())
    except Exception:  # noqa: BLE001
        return False


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """Use the configured checkpoint folder; set ``fallback`` only where none is set.

    ``spark.checkpoint.dir`` cannot change at run time, so the fallback is set on
    the SparkContext, which ``checkpoint_dir`` reads when the setting is absent.
    """
    current = checkpoint_dir(spark)
    if current:
        return current
    spark.sparkContext.setCheckpointDir(fallback)
    return checkpoint_dir(spark) or fallback
