"""Spark-native content deduplication, archive layout and corpus processing."""

__version__ = "0.1.0"
