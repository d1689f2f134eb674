"""Spark-native analysis of relationships between time series."""
