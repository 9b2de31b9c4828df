"""Spark-native coevolution analytics over aligned sequences."""

__version__ = "0.1.0"
