"""Signal research and corpus preparation as partitioned Spark jobs."""
