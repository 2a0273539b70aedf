"""Row operators and feature aggregates."""
