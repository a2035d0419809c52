"""Spark-native analytics over document and source-code corpora."""

__version__ = "0.1.0"
