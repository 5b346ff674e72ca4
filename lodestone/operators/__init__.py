"""operators of the specification engine."""
