"""Managed tables: immutable Parquet versions under a manifest."""
