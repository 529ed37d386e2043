"""Spark-native analytics for language-model corpora and evaluation tables."""
