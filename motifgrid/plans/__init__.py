"""Patterns and planning, on the driver."""
