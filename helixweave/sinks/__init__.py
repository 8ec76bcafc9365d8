"""sinks of the mapping engine."""
