"""Registered queries and their DuckDB texts."""
