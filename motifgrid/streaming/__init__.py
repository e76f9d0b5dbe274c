"""Counts kept up to date over edge streams."""
