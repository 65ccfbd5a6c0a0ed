"""Taxonomy analytics and data processing on PySpark."""
