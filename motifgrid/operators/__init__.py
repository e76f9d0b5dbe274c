"""DataFrame operators on graphs."""
