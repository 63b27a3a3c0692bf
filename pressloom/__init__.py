"""Spark-native analytics for large newspaper-article corpora."""

__version__ = "0.1.0"
