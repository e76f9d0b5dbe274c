"""Count, list and explain matches of a pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import Graph
from .operators import array_extend, bags, closed_form, kernel, sql_join, structure
from .plans import planner
from .plans.decompose import Decomposition
from .plans.pattern import Pattern

STRATEGIES = ("auto", "sql_join", "array_extend", "bags", "closed_form", "kernel")


def count(g: Graph, p: Pattern, strategy: str = "auto", iep: bool = False, order: list[int] | None = None, hint_bags=None) -> DataFrame:
    """One row ``n_matches``: subgraphs isomorphic to the pattern, non-induced, each once.

    ``iep`` counts twin vertices by a binomial. ``order`` and ``hint_bags`` fix the plan.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    if p.labels:
        from .labels import labelled_matches

        return labelled_matches(g, p).agg(F.count("*").alias("n_matches"))
    if iep:
        return array_extend.count_twins(g, p)
    if strategy == "auto" or hint_bags:
        chosen = planner.plan(g, p, strategy, order, hint_bags)
        strategy, order = chosen.strategy, chosen.order
        if strategy == "bags" and hint_bags is None:
            hint_bags = chosen.bags
    if strategy == "closed_form":
        name = closed_form.formula_for(p)
        if name is None:
            raise ValueError("no formula for this pattern")
        return closed_form.FORMULAS[name][1](g)
    if strategy == "bags":
        return bags.count(g, p, Decomposition(tuple(map(frozenset, hint_bags)), 0.0) if hint_bags else None)
    if strategy == "kernel":
        return kernel.count(g, p)
    if strategy == "sql_join":
        return sql_join.matches(g, p).agg(F.count("*").alias("n_matches"))
    return array_extend.count(g, p, order)


def enumerate_matches(g: Graph, p: Pattern, strategy: str = "array_extend") -> DataFrame:
    """``v0..v{k-1}``: every subgraph once, column i the data vertex of pattern vertex i."""
    how = {"array_extend": array_extend.matches, "sql_join": sql_join.matches, "bags": bags.matches}
    if p.labels:
        from .labels import labelled_matches

        return labelled_matches(g, p)
    return how[strategy](g, p)


def local_counts(g: Graph, p: Pattern) -> DataFrame:
    """``(orbit, v, n)``: matches that hold a vertex at a place of each orbit."""
    return structure.orbit_counts(g, p)


def explain(g: Graph, p: Pattern, strategy: str = "auto") -> str:
    return planner.plan(g, p, strategy).text()
