"""Marginalia: a Spark-native retrieval and analytics engine for text notes."""
