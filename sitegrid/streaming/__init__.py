"""Aggregates over arriving samples."""
