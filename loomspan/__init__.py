"""Spark-native processing of span-annotated text."""
