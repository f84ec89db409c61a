"""Structured Streaming over files and their records."""
