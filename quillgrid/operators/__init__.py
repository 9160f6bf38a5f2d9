"""Operators over DataFrames: filters, aggregates, grids, profiles, join keys, drift."""
