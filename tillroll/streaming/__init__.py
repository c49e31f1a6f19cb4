"""Structured Streaming ingestion of report files."""
