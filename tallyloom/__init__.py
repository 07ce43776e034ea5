"""Spark-native analytics for software-quality records and training-data tables."""
