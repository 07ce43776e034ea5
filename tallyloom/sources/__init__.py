"""Readers and writers."""

from tallyloom.sources.tables import table

__all__ = ["table"]
