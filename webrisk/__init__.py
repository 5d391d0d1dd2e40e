"""webrisk: web-threat analytics as Spark DataFrame jobs."""
