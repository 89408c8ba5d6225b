"""Spark-native exact nearest-neighbour search and benchmark-log analytics."""

__version__ = "0.1.0"
