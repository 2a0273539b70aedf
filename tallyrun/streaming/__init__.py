"""Structured Streaming: feature tables kept per entity."""

from .tables import stream_table

__all__ = ["stream_table"]
