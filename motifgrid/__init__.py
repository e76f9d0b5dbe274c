"""Graph pattern counting on Spark."""

from .api import count, enumerate_matches, explain, local_counts
from .model import Graph
from .plans.pattern import Pattern

__all__ = ["Graph", "Pattern", "count", "enumerate_matches", "explain", "local_counts"]
