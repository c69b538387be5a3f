"""Kinlink: Spark-native batch entity resolution and corpus preparation."""
