"""Frequencies of an alignment that grows, with Structured Streaming."""
