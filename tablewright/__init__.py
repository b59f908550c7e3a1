"""Table cleaning and verified statistics as plain Spark DataFrame jobs."""
