"""Spark-native retrieval analytics: sources, ranking, evaluation, statistics and streaming."""
