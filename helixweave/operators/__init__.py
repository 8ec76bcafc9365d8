"""operators of the mapping engine."""
