"""Queries of every operator over the given tables, with the same queries in ANSI SQL."""
