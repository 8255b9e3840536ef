"""Streaming forms of the row-local operators."""
