"""Tidemark: market-data analytics as Spark DataFrame and SQL jobs."""
