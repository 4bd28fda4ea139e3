"""Streaming forms of the measurements over time."""
