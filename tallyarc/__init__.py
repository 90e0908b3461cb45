"""Spark-native analytics over knowledge archives and task boards."""
