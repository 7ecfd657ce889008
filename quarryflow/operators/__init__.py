"""Joins, aggregates, windows, warehouse, quality, incremental loads and scores over DataFrames."""
