"""Spark-native analytics for long instrument records: ingest, tag, detect, grid, summarise."""
