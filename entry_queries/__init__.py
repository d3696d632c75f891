"""Registered queries: each runs an operator over the given tables, most with an SQL twin."""
