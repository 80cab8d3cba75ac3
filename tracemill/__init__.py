"""Spark-native analytics over execution-trace event logs."""
