"""Spark-native analytics over public procurement contracts."""
