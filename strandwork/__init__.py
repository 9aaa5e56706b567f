"""Spark-native analytics for biological sequence collections."""
