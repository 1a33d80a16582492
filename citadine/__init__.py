"""Spark-native analytics of incidents on street networks."""
