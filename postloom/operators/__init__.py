"""DataFrame transforms: validate, enrich, deduplicate, score, store, serve and report."""
