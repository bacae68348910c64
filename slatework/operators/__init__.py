"""Filters, aggregates, cleaning, profiles, drill-down and reports over DataFrames."""
