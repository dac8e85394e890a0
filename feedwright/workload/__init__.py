"""Queries over the benchmark tables, with the SQL they are checked against."""
