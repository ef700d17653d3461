"""Sources of the completion engine."""
