"""Spark-native operators for turning article, page and document tables into short, duplicate-free results."""
