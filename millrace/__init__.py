"""Millrace: a PySpark-native engine for guarded structured queries, ingestion and data quality."""
