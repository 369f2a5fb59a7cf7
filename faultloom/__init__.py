"""Spark-native analytics over failure evidence, traces and experiment results."""
