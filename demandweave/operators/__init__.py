"""Operators on DataFrames: matching, classification, deduplication, reconciliation."""
