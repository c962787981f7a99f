"""Spark-native record reconciliation between two divergent systems."""
