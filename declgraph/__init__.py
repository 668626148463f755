"""Spark-native analytics over source-code facts, with a generic relational core."""

__version__ = "0.1.0"
