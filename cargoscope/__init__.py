"""cargoscope: freight-billing and trip-punctuality reporting as Spark DataFrame operators.

Layout
------
sources/    table readers, the role frames built from the star schema, catalog helpers
functions/  Column builders: predicates, exact-rounding measures, scalar formats, tags
operators/  DataFrame -> DataFrame operators: KPI rows, rollups, distributions,
            scorecards, buckets, facets, top-k, paging, shares
plans/      the dashboard panels and saved views composed from the operators,
            plus the DuckDB oracle text used by the correctness check
sinks/      JSON / CSV / Parquet writers (distributed, never collected)
llm/        operators of a training-data pipeline (optional; nothing else imports it)
"""

__version__ = "0.1.0"


def __getattr__(name: str):
    """Lazy shortcuts to the usual entry points (importing the package stays cheap)."""
    import importlib

    shortcuts = {
        "dashboard": "cargoscope.plans.dashboard",
        "views": "cargoscope.plans.views",
        "registry": "cargoscope.plans.registry",
        "roles": "cargoscope.sources.roles",
        "session": "cargoscope.session",
    }
    if name in shortcuts:
        return importlib.import_module(shortcuts[name])
    raise AttributeError(name)
