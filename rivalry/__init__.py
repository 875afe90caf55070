"""Spark DataFrame operators for two-sided event tables (matches between two
entities, each with a score, inside a season)."""

__all__ = ["session"]
