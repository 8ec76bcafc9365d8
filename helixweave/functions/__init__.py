"""functions of the mapping engine."""
