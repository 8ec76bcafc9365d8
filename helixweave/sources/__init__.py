"""sources of the mapping engine."""
