"""Spark-native analytics for document corpora and the systems that process them."""
