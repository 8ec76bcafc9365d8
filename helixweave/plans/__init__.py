"""plans of the mapping engine."""
