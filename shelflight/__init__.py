"""Catalogue and ranking analytics as DataFrame and Structured Streaming jobs."""
