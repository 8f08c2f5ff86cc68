"""SNK-3, SNK-4 and AGF-2: saved views kept as mergeable partial measures, brought up to date month by month.

Seven of the saved views are sums and counts per key, and every average or share is made from two of those. Their
*partials*, the sums and counts per creation month and key, are stored, one folder per month; a view is the sum of its
partials over the months, finished like the view over all rows. The detail view is stored as rows. The distinct
companies of a month are a bitmap over a stored dictionary of companies, so the exact number of companies in any range of
months is an OR of bitmaps.

``refresh`` follows the parts of the billing table. If it only gained parts, only these are read: the months they hold
are written again in a new *run*, as the stored partials plus those of the new rows, and no other month is touched. Any
other change is a run over all parts. A version record (``VersionLog``) names the runs of all views at once: a reader in
the middle sees the old rows or the new ones, in all views alike. Versions are ordered by the newest part that they cover,
so a refresh over an older snapshot never takes rows back. Files of older versions stay until the folder is cleared.

A view is read by its name from the folder alone, with its labels, by any application and without a metastore. Rows
whose creation date is null are a month of their own. The driver holds the record: at most ``MOST_PARTS`` runs with the
months that each wrote. The rows of a view come without an order where the view only hints at one (the detail).
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from cargoscope.functions import measures as M
from cargoscope.functions.measure_sets import BillingMeasures
from cargoscope.functions.predicates import month_folders, not_blank, present
from cargoscope.functions.scalars import month_key, month_start
from cargoscope.functions.vocabulary import BILLING
from cargoscope.operators import kpis as K
from cargoscope.operators import rollups as R
from cargoscope.operators import topk as TK
from cargoscope.operators.detail import view_detail_columns
from cargoscope.plans.views import LABELS, VIEWS
from cargoscope.session import checkpoint_dir
from cargoscope.sinks.versions import VersionLog
from cargoscope.sources import roles as RL
from cargoscope.sources.snapshots import new_name

#: The month of a stored row; null dates have a folder of their own.
MONTH = RL.BILLING_MONTH_PARTITION
DETAIL = "v_fletes_detalle"
KPIS, COMPANIES, DICTIONARY = "kpis", "companies", "company_ids"
#: Stored as rows: a run adds to the runs before it, and takes no month's place.
ROWS = (DETAIL, DICTIONARY)
#: Raise this number when a view's definition or the layout changes.
DEFINITION = 1
#: Parts in which new companies are numbered side by side.
NUMBERED_BY = 64


@dataclass(frozen=True)
class Rollup:
    """A view of sums and counts per key; ``finish`` orders or cuts the measures of all rows."""

    keys: list[Column]
    keep: Column
    measures: list[Column | M.Ratio]
    finish: Callable[[DataFrame], DataFrame]

    def partials(self, rows: DataFrame) -> DataFrame:
        return rows.where(self.keep).groupBy(MONTH, *self.keys).agg(*M.split(self.measures))


def _ordered(*order: tuple[str, str]) -> Callable[[DataFrame], DataFrame]:
    def finish(df: DataFrame) -> DataFrame:
        return df.orderBy(*[F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_first() for c, way in order])

    return finish


def rollups() -> dict[str, Rollup]:
    """The views that are stored as partials, and the KPI row without its distinct count."""
    m = BillingMeasures()
    full = R.view_measures()
    month = month_key("fecha").alias("mes")

    def profile(dim: str) -> Rollup:
        return Rollup([F.col(dim)], not_blank(dim), [m.trips("viajes"), m.total("total_tarifa"), m.avg("tarifa_promedio")],
                      _ordered(("total_tarifa", "desc"), (dim, "asc")))

    return {
        "v_fact_mensual": Rollup([month, month_start("fecha").alias("mes_date")], present("fecha"), [*full, R.billed_share()],
                                 _ordered(("mes", "asc"), ("mes_date", "asc"))),
        "v_fact_compania": Rollup([F.col("nombre_compania")], present("nombre_compania"), [*full, R.billed_share()],
                                  _ordered(("fact_total", "desc"), ("nombre_compania", "asc"))),
        "v_fact_transportista": Rollup([F.col("transportista")], not_blank("transportista"), full,
                                       _ordered(("total_tarifa", "desc"), ("transportista", "asc"))),
        "v_status_crisar": profile("status_crisar"),
        "v_envio_factura": profile("estado_envio_factura"),
        "v_pendientes_top": Rollup([F.col(c) for c in ("nombre_compania", "nombre_sucursal", "transportista")],
                                   F.col("estado_contable") == BILLING.unbilled, [m.trips("viajes"), m.total("total_pendiente")],
                                   lambda df: TK.top_k(df, [("total_pendiente", "desc")], 20)),
        "v_on_time_resumen": Rollup([month, F.col("nombre_compania")], present("fecha") & present("estado_viaje"), R.on_time_measures(),
                                    lambda df: _ordered(("mes", "asc"), ("nombre_compania", "asc"))(
                                        df.withColumn("pct_on_time", M.count_share_of("on_time", "total_viajes")))),
        KPIS: Rollup([], F.lit(True), K.billing_kpi_sums(), lambda df: df),
    }


def merge(parts: DataFrame, schema: StructType, keys: list[str]) -> DataFrame:
    """One row per key: sums of sums and counts, in their own types, and ORs of bitmaps; no rows count as 0."""
    made = []
    for f in schema:
        if f.name == MONTH or f.name in keys:
            continue
        if isinstance(f.dataType, BinaryType):
            total = F.bitmap_or_agg(F.col(f"`{f.name}`"))
        else:
            total = F.sum(f"`{f.name}`").cast(f.dataType)
            total = total if f.nullable else F.coalesce(total, F.lit(0).cast(f.dataType))
        made.append(total.alias(f.name))
    return parts.groupBy(*keys).agg(*made)


def _numbered(names: DataFrame, start: Column) -> DataFrame:
    """(nombre_compania, id): ids from ``start`` + 1 without a gap, counted per part of the names and then by offsets."""
    parted = names.withColumn("part", F.pmod(F.xxhash64("nombre_compania"), F.lit(NUMBERED_BY)))
    sizes = parted.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # NUMBERED_BY rows
    place = F.row_number().over(Window.partitionBy("part").orderBy("nombre_compania"))
    return parted.withColumn("place", place).join(F.broadcast(before), "part").select(
        "nombre_compania", (start + F.col("before") + F.col("place")).cast("long").alias("id"))


def folder_of(spark: SparkSession, sf_dir: str) -> str:
    """Where the saved views of an input folder lie, below the cluster's shared folder."""
    base = checkpoint_dir(spark)
    if base is None:
        raise ValueError("spark.checkpoint.dir must name a shared folder for the saved views")
    folder = os.path.abspath(sf_dir) if "://" not in sf_dir else sf_dir
    return f"{base}/cargoscope-saved/{hashlib.sha1(folder.encode()).hexdigest()[:16]}"


class SavedViews:
    """The saved views below ``base``, a folder that all applications share."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, f"{base.rstrip('/')}/v{DEFINITION}"
        self.log = VersionLog(spark, f"{self.base}/versions")
        self.record: dict | None = None

    # --- reading -------------------------------------------------------------------

    def open(self) -> SavedViews:
        """Take the latest version; everything read from this object is of that version until it is opened again."""
        self.record = self.log.latest()
        if self.record is None:
            raise FileNotFoundError(f"no saved views below {self.base}")
        return self

    def _version(self) -> dict:
        return self.record or self.open().record

    def names(self) -> list[str]:
        return [n for n in VIEWS if n in self._version()["schemas"]]

    def labels(self) -> dict[str, str]:
        return dict(self._version()["labels"])

    def _schema(self, name: str, record: dict) -> StructType:
        return StructType.fromJson(record["schemas"][name])

    def stored(self, name: str, record: dict | None = None) -> DataFrame:
        """What is stored under ``name`` in the version: of each month the run that wrote it last."""
        record = record or self._version()
        schema = self._schema(name, record)
        fields = [f for f in schema if f.name != MONTH] + [StructField("run", StringType()), StructField(MONTH, StringType())]
        paths = [f"{self.base}/{name}/run={r['id']}" for r in record["runs"]]
        frame = self.spark.read.schema(StructType(fields)).option("basePath", f"{self.base}/{name}").parquet(*paths)
        if name not in ROWS:
            later: set[str] = set()
            for r in reversed(record["runs"]):
                if later:
                    frame = frame.where((F.col("run") != r["id"]) | ~F.coalesce(F.col(MONTH), F.lit("")).isin(sorted(later)))
                later |= set(r["months"])
        return frame.select(*schema.names)

    def view(self, name: str) -> DataFrame:
        """The rows of a saved view."""
        if name not in VIEWS:
            raise KeyError(f"unknown view {name!r}; known: {', '.join(VIEWS)}")
        if name == DETAIL:
            return self.stored(DETAIL).drop(MONTH)
        return self._finished(name, self.stored(name))

    def _finished(self, name: str, parts: DataFrame) -> DataFrame:
        rollup, schema = rollups()[name], self._schema(name, self._version())
        keys = schema.names[1: len(schema.names) - len(M.split(rollup.measures))]
        return rollup.finish(M.finished(merge(parts, schema, keys), rollup.measures))

    def kpis(self, mes_desde: str | None = None, mes_hasta: str | None = None) -> DataFrame:
        """AGG-3 over the creation months from ``mes_desde`` to ``mes_hasta``, from stored sums and bitmaps."""
        def between(parts: DataFrame) -> DataFrame:
            if not mes_desde and not mes_hasta:
                return parts
            return parts.where(month_folders(MONTH, mes_desde, mes_hasta))

        sums = self._finished(KPIS, between(self.stored(KPIS)))
        held = merge(between(self.stored(COMPANIES)), self._schema(COMPANIES, self._version()), ["bucket"])
        companies = held.agg(F.coalesce(F.sum(F.bitmap_count("held")), F.lit(0).cast("long")))
        return sums.select("total_viajes", companies.scalar().alias("companias"), *sums.columns[1:])

    def register(self, prefix: str = "") -> list[str]:
        """Make the version's views readable by name in this session's SQL."""
        for name in self.names():
            self.view(name).createOrReplaceTempView(f"{prefix}{name}")
        return [f"{prefix}{name}" for name in self.names()]

    # --- writing -------------------------------------------------------------------

    def refresh(self, sf_dir: str, labels: Mapping[str, str] = LABELS) -> SavedViews:
        """Bring all views up to the pinned snapshot of ``sf_dir`` and open the result.

        Only parts of the billing table that the latest version doesn't cover are read, and only their months written.
        A version over a newer snapshot is left as it is.
        """
        parts = RL.parts(self.spark, sf_dir, "billing")
        newest = max(p.rsplit("/", 1)[-1] for p in parts)
        held = self.log.latest()
        if held and (held["newest"] > newest or (held["parts"], held["labels"]) == (parts, dict(labels))):
            return self.open()
        grown = held if held and set(held["parts"]) <= set(parts) else None
        new = [p for p in parts if not grown or p not in grown["parts"]]
        record = {"newest": newest, "number": held["number"] + 1 if held else 1, "parts": parts, "labels": dict(labels),
                  "runs": grown["runs"] if grown else [], "schemas": grown["schemas"] if grown else {}}
        if new:
            run, schemas = self._write_run(RL.read_parts(RL.snapshot(self.spark, sf_dir).builder(), sf_dir, "billing", new), grown)
            record.update(runs=[*record["runs"], run], schemas=schemas)
        self.log.put(f"{newest}.{record['number']:08d}", record)
        return self.open()

    def _write_run(self, rows: DataFrame, grown: dict | None) -> tuple[dict, dict]:
        """Write the partials of ``rows``, with those that ``grown`` stores for the same months, and the rows themselves."""
        run = {"id": new_name(), "months": sorted(r[0] or "" for r in rows.select(MONTH).distinct().collect())}
        schemas: dict[str, dict] = {}

        def write(name: str, frame: DataFrame, by_month: bool = True) -> None:
            writer = frame.write.mode("errorifexists").option("compression", "zstd")
            (writer.partitionBy(MONTH) if by_month else writer).parquet(f"{self.base}/{name}/run={run['id']}")

        def write_partials(name: str, fresh: DataFrame, keys: list[str]) -> None:
            schemas[name] = fresh.schema.jsonValue()
            if grown:
                touched = F.coalesce(F.col(MONTH), F.lit("")).isin(run["months"])
                both = self.stored(name, grown).where(touched).unionByName(fresh)
                fresh = merge(both, fresh.schema, [MONTH, *keys]).select(*fresh.columns)
            # Few rows a month; AQE puts months together or splits a month that is large after all.
            write(name, fresh.hint("rebalance", F.col(MONTH)))

        def write_rollup(name: str, rollup: Rollup) -> None:
            fresh = rollup.partials(rows)
            write_partials(name, fresh, fresh.columns[1: len(fresh.columns) - len(M.split(rollup.measures))])

        def write_detail() -> None:
            # The rows lie in month folders, so no shuffle is needed to write them by month again.
            detail = rows.where(present("fecha")).select(MONTH, *view_detail_columns())
            schemas[DETAIL] = detail.schema.jsonValue()
            write(DETAIL, detail.sortWithinPartitions(MONTH, F.col("fecha").desc()))

        def write_companies() -> None:
            seen = rows.where(present("nombre_compania")).select(MONTH, "nombre_compania").distinct()
            names, start = seen.select("nombre_compania").distinct(), F.lit(0)
            if grown:
                known = self.stored(DICTIONARY, grown)
                start = known.agg(F.coalesce(F.max("id"), F.lit(0).cast("long"))).scalar()
                names = names.join(known, "nombre_compania", "left_anti")
            ids = _numbered(names, start)
            schemas[DICTIONARY] = ids.schema.jsonValue()
            write(DICTIONARY, ids, by_month=False)
            # Ids are read from the written table, so a task that runs again finds the same ones.
            now = {"runs": [*(grown["runs"] if grown else []), run], "schemas": schemas}
            numbered = seen.join(self.stored(DICTIONARY, now), "nombre_compania")
            write_partials(COMPANIES, numbered.groupBy(MONTH, F.bitmap_bucket_number("id").alias("bucket")).agg(
                F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("held")), ["bucket"])

        with ThreadPoolExecutor(max_workers=4) as pool:
            jobs = [pool.submit(write_companies), pool.submit(write_detail)]
            jobs += [pool.submit(write_rollup, name, rollup) for name, rollup in rollups().items()]
            for job in jobs:
                job.result()
        return run, schemas
