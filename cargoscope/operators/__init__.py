"""DataFrame -> DataFrame operators; every one is built from Spark's own expressions."""
