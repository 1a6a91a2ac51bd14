"""Document intake and evidence classification as Spark DataFrame jobs."""
