"""Structured Streaming: sources, chained stateful joins, a durable runner."""
