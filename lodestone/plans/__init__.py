"""plans of the specification engine."""
