"""Spark-native analytics over captured web crawls."""

__version__ = "0.1.0"
