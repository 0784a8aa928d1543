"""Quillmask: a Spark-native engine that finds, reviews and removes personal information in document collections."""
