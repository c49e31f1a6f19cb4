"""Registered queries, their DuckDB oracle SQL, the overview and report round trips."""
