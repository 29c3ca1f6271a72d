"""Spark-native document-evidence analytics: parsing, splitting, retrieval, ranking, decisions, statistics."""
