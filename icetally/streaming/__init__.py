"""Incremental arrival of payload files."""
