"""Spark-native analytics for large 3-D point data."""
