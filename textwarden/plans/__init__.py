"""Queries over the given tables: one per operator, with its SQL."""
