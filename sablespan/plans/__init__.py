"""Queries over the standard tables, each with its DuckDB counterpart."""
