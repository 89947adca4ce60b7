"""Spark-native building blocks of the curation and evaluation engine."""
