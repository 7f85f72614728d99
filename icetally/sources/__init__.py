"""Readers, incremental selection and writers."""
