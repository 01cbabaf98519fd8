"""Spark-native corpus indexing and retrieval engine."""

__version__ = "0.1.0"
