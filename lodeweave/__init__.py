"""Spark-native context retrieval, packing and corpus preparation."""
