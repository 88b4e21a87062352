"""Spark-native analytics for media libraries."""
