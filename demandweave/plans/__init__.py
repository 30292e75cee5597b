"""Composite queries: star schema, read model, skill gap, data checks and the full run."""
