"""Spark-native fractional region coverage and large-scale data preparation."""
