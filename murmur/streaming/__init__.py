"""Structured Streaming variants of ingestion and the daily rollup."""
