"""Spark-native duplicate detection, leakage analytics and corpus preparation."""
