"""Quarry: a Spark-native analytics engine."""
