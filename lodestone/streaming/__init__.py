"""streaming of the specification engine."""
