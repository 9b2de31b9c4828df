"""Scalar functions over sequences and headers, as Spark columns."""
