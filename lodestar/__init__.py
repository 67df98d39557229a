"""Spark-native analytics over vectors and proximity graphs."""
