"""streaming of the mapping engine."""
