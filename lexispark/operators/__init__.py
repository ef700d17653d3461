"""Operators of the completion engine."""
