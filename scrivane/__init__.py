"""Spark-native engine for writing-style analytics and text data processing."""
