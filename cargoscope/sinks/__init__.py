"""Writers: results leave Spark from the executors, never through the driver."""
