"""Structured Streaming beside the index."""
