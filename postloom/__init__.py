"""Listing analytics on Spark: read, enrich, deduplicate, score, store, serve and report."""
