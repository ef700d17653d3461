"""Plans of the completion engine."""
