"""Request-quota operators on event streams, with their batch twins."""
