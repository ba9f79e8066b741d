"""Spark-native analytics for aerial survey data."""
