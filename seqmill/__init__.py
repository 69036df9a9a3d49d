"""Spark-native analytics over ordered event logs."""
