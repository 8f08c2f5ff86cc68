"""Column builders used by the operators (no Python UDFs anywhere)."""
