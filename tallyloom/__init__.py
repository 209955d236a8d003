"""Spark-first engine for declarative synthetic-data planning and data-quality analytics."""
