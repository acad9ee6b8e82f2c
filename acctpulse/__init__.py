"""Account health analytics as Spark DataFrame jobs."""
