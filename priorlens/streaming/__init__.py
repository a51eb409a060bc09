"""Structured Streaming forms of the two long-lived states."""
