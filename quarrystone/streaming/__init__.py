"""Structured Streaming: incremental file ingestion and windowed aggregation."""
