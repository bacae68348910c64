"""Tabular exploration on Spark: ingest, clean, profile, filter, aggregate, drill down, report."""
