"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
  {"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ..., ...}

Each query runs to completion through Spark's ``noop`` sink (the whole plan
executes, nothing is collected), best of ``$BENCH_REPEAT`` runs; the time
includes building the DataFrame, so eager steps (checkpoints) are counted. The one-time
build of the role tables is timed separately (``roles_build_sec``), and a few
``comparisons``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from cargoscope.functions.predicates import month_range, not_blank  # noqa: E402
from cargoscope.functions.scalars import month_key  # noqa: E402
from cargoscope.operators import facets as FC  # noqa: E402
from cargoscope.operators.detail import fact_page  # noqa: E402
from cargoscope.plans import dashboard as P  # noqa: E402
from cargoscope.plans import registry  # noqa: E402
from cargoscope.session import build_session, ensure_checkpoint_dir  # noqa: E402
from cargoscope.sources.roles import build_roles, role  # noqa: E402
from cargoscope.sources.tables import table  # noqa: E402


def run_noop(make) -> float:
    """Build the DataFrame (including any eager step such as a checkpoint) and run it to completion."""
    t0 = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def best(make, repeat: int) -> float:
    return min(run_noop(make) for _ in range(repeat))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="bench-ckpt-", dir="/tmp"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    table(spark, sf_dir, "nation").count()  # JVM warm-up, so the build time is the build's own
    t0 = time.perf_counter()
    build_roles(spark, sf_dir, refresh=True)
    roles_build = time.perf_counter() - t0

    t0 = time.perf_counter()
    registry.run(spark, "saved_kpis", sf_dir)  # writes the saved views
    saved_build = time.perf_counter() - t0

    run_noop(lambda: registry.run(spark, "monthly_trend", sf_dir))  # warm-up (JIT, file listing)
    times, errors = {}, {}
    for name in registry.QUERIES:
        try:
            times[name] = round(best(lambda n=name: registry.run(spark, n, sf_dir), repeat), 4)
        except Exception as exc:  # noqa: BLE001 - record and keep measuring the others
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"

    billing = role(spark, sf_dir, "billing")

    def facets_n_scans():
        out = None
        for facet, col in FC.FACT_FACETS.items():
            part = billing.where(not_blank(col)).select(F.lit(facet).alias("facet"), F.col(col).alias("val")).distinct()
            out = part if out is None else out.unionByName(part)
        months = billing.where(F.col("fecha_creacion").isNotNull()).select(
            F.lit("meses").alias("facet"), month_key("fecha_creacion").alias("val")).distinct()
        return out.unionByName(months)

    def separate_operations_panels() -> float:
        from cargoscope.operators import distributions as D
        total = best(lambda: FC.status_panel(billing), repeat)
        for col in ("status_crisar", "estado_envio_factura", "tipo_fact", "aprobacion"):
            total += best(lambda c=col: D.amount_by(billing, c, "drop_blank"), repeat)
        return total

    def separate_commercial_panels() -> float:
        from cargoscope.operators import distributions as D
        from cargoscope.operators import kpis as K
        from cargoscope.operators import rollups as R
        from cargoscope.operators import scorecards as S
        return (best(lambda: K.executive_summary(billing), repeat) + best(lambda: R.monthly_trend(billing), repeat)
                + best(lambda: S.company_ranking(billing), repeat)
                + best(lambda: D.amount_by(billing, "status_contabilidad_aje", "drop_blank"), repeat))

    try:
        comparisons = {
            "commercial_panels_one_scan": times.get("commercial_panels"),
            "commercial_panels_4_queries": round(separate_commercial_panels(), 4),
            "operations_panels_one_scan": times.get("operations_panels"),
            "operations_panels_5_queries": round(separate_operations_panels(), 4),
            "status_panel_one_scan": times.get("status_panel"),
            "status_panel_union_4_scans": times.get("status_panel_union"),
            "fact_facets_one_scan": times.get("fact_facets"),
            "fact_facets_12_scans": round(best(facets_n_scans, repeat), 4),
            "month_filter_raw_column": round(best(
                lambda: billing.where(month_range("fecha_creacion", "1996-03", "1997-02")).select("tarifa_final"),
                repeat), 4),
            "month_filter_raw_column_and_month_folders": round(best(
                lambda: billing.where(P.fact_where(billing, mes_desde="1996-03", mes_hasta="1997-02")).select("tarifa_final"),
                repeat), 4),
            "month_filter_formatted_text": round(best(
                lambda: billing.where(month_key("fecha_creacion").between("1996-03", "1997-02")).select("tarifa_final"),
                repeat), 4),
            "page_1": round(best(lambda: fact_page(billing, 1, 50), repeat), 4),
            "page_1000": round(best(lambda: fact_page(billing, 1000, 50), repeat), 4),
        }
    except Exception as exc:  # noqa: BLE001 - comparisons are extra; never lose the main result
        comparisons = {"error": f"{type(exc).__name__}: {str(exc)[:200]}"}
    total = round(sum(times.values()), 4)
    times.update({name: None for name in errors})
    print(json.dumps({
        "metric": "total_query_sec", "value": total, "unit": "sec", "queries": times, "sf": sf,
        "n_queries": len(times), "roles_build_sec": round(roles_build, 4),
        "saved_build_sec": round(saved_build, 4),
        "total_with_build_sec": round(total + roles_build + saved_build, 4), "cpus": cpus, "repeat": repeat,
        "comparisons": comparisons, "errors": errors,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
