"""Spark-native entity resolution, data quality and serving analytics."""
