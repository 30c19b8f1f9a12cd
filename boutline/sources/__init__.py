"""Landed documents, dimensions and stored tables."""
