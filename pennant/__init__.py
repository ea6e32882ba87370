"""Spark-native analytics for sports leagues."""
