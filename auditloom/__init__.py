"""Spark-native audit analytics over corpora of source projects."""

__version__ = "0.1.0"
