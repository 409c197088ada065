"""Spark-native intake, privacy, prompt and batch-inference operators."""
