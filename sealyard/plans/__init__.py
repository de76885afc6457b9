"""Queries over the shared tables, one for each operator, and the same in SQL."""
