"""Training-data operators: mixing, quality, deduplication, decontamination and media columns.

Nothing outside this package imports it. ``covarium.llm.queries`` holds the registered queries.
"""
