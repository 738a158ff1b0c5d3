"""Structured Streaming ingest of document files."""
