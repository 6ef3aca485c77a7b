"""Spark-first curation and analytics for media-instruction data."""
