"""Structured Streaming forms of the ordered recurrences (an extension)."""
