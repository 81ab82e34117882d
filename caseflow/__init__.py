"""Case cohorts, prompt sets and label evaluation as Spark DataFrame jobs."""
