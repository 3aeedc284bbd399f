"""Lodestar: a Spark-native discovery and search engine."""
