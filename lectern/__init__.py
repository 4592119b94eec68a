"""Feed-reader analytics as Spark jobs: sync, listings, counts, state, text, search, streams."""
