"""functions of the specification engine."""
