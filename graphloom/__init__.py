"""Spark-native document-to-knowledge-graph analytics."""
