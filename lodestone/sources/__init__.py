"""sources of the specification engine."""
