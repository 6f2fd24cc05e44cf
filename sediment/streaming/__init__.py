"""Structured Streaming variants of the batch operators."""

from sediment.streaming.flows import activity, deduplicated, fact_changes, read_table, routed, run_available

__all__ = ["activity", "deduplicated", "fact_changes", "read_table", "routed", "run_available"]
