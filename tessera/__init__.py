"""Spark-first document, retrieval and catalogue analytics."""
