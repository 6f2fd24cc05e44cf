"""Readers for the engine's tables."""

from sediment.sources.tables import table, tables

__all__ = ["table", "tables"]
