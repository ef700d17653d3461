"""Streaming of the completion engine."""
