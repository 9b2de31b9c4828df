"""Readers and writers of alignments, their side tables, structures and results."""
