"""Spark-native near-duplicate grouping, leak-free splitting and auditing of text tables."""

__version__ = "0.1.0"
