"""Queries over the given tables: one an operator, with SQL twins."""
