"""Column functions on adjacency arrays."""
