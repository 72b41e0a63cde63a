"""Structured Streaming forms of the time-based operators."""
