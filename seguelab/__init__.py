"""Spark-native sequence and transition analytics."""
