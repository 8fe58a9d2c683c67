"""Incremental ingestion of files and messages."""
