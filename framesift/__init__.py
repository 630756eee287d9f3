"""Framesift: a Spark-native engine for timeline retrieval, ranking and data preparation."""
