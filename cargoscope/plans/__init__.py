"""Dashboard panels, saved views, the query registry and its DuckDB oracle."""
