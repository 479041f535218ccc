"""Structured Streaming forms of the run-history operators. Each takes and returns a streaming DataFrame."""
