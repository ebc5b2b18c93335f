"""Spark-native engine for triplet relative-value research."""
