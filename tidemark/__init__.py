"""Data operations on Spark tables and streams: documents, settings, caches, state."""
