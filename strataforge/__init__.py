"""Spark-native analytics over versioned technical documents and their change review."""
