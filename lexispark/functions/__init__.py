"""Functions of the completion engine."""
