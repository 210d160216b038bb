"""Spark-native engine for the data side of offline batch inference."""
