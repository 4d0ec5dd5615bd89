"""Trial and event analytics as Spark DataFrame jobs."""
