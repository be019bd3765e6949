"""Structured Streaming reads."""
