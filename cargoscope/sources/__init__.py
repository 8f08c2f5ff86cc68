"""Readers for the driver's tables and the role frames derived from them."""

from cargoscope.sources.tables import TABLE_NAMES, load_tables, table  # noqa: F401
