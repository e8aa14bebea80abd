"""Routing-evaluation analytics and training-data jobs, written as Spark DataFrame programs."""
