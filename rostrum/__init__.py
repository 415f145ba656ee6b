"""rostrum: conference and call-for-papers analytics as PySpark DataFrame jobs."""
