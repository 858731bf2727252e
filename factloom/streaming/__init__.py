"""Structured Streaming: change events applied to a table."""
