"""Readers and writers, and adapters from the star schema to the subsurface tables."""
