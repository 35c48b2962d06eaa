"""Spark-native analytics over evaluation suites, predictions, event logs and annotations."""
