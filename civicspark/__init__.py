"""Spark-native analytics for large survey corpora."""
