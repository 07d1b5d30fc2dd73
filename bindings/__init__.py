"""Queries that run the operators on the given tables, each with its SQL counterpart."""
