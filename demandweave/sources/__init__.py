"""Inputs: catalogs, raw payloads and stored tables."""
