"""Pipelines over whole alignments, and the tables behind their plots."""
