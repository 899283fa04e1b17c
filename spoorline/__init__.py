"""Spark-native track analytics."""
