"""Queries by name, their SQL, and the batch pipeline."""
