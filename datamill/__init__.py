"""Spark-native dataset curation and evaluation analytics."""
