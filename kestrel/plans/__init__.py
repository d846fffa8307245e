"""Operators bound to the driver tables (queries) and their DuckDB reference SQL."""
