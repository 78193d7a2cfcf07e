"""Hybrid search, ranking, enrichment and audit operators over Spark DataFrames."""
