"""Operators over DataFrames: extraction, analysis, indexing, search, suggestions, barrels, metrics."""
