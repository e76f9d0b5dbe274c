"""Decomposed matching: one DataFrame per bag, joined along the tree on shared vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..plans.decompose import Decomposition, decompositions
from ..plans.pattern import Pattern, reduce_rules
from . import array_extend


def bag_matches(g: Graph, p: Pattern, bag: frozenset[int], rules) -> DataFrame:
    """Injective matches of a bag's induced pattern, with the rules that lie in it."""
    part = sorted(bag)
    at = {v: i for i, v in enumerate(part)}
    inner = [(at[a], at[b]) for a, b in rules if a in at and b in at]
    found = array_extend.matches(g, p.induced(part), rules=inner)
    return found.toDF(*[f"v{v}" for v in part])


def pick_rules(p: Pattern, d: Decomposition) -> frozenset[tuple[int, int]]:
    """The rule set with most pairs inside bags."""
    sets = p.rule_sets()
    return max(sets, key=lambda rs: (sum(any({a, b} <= bag for bag in d.bags) for a, b in rs), -len(rs), sorted(rs)))


def matches(g: Graph, p: Pattern, d: Decomposition | None = None) -> DataFrame:
    """Every subgraph once. Bags of equal shape and rules are one DataFrame,
    so their exchange is reused; an empty bag empties the plan at run time."""
    d = d or decompositions(p)[0]
    rules = set(reduce_rules(pick_rules(p, d)))
    out: DataFrame | None = None
    have: set[int] = set()
    for bag in d.bags:
        step = bag_matches(g, p, bag, rules)
        if out is None:
            out, have = step, set(bag)
            continue
        out = out.join(step, [f"v{v}" for v in sorted(bag & have)])
        for a in have - bag:
            for b in bag - have:
                x, y = F.col(f"v{a}"), F.col(f"v{b}")
                out = out.where(x < y if (a, b) in rules else y < x if (b, a) in rules else x != y)
        have |= bag
    return out.select(*[f"v{i}" for i in range(p.n)])


def semi_reduced(g: Graph, p: Pattern, d: Decomposition | None = None) -> list[DataFrame]:
    """The bags after a pass of semi-joins from the last to the first."""
    d = d or decompositions(p)[0]
    rules = reduce_rules(pick_rules(p, d))
    frames = [bag_matches(g, p, b, rules) for b in d.bags]
    for i in range(len(d.bags) - 1, 0, -1):
        for j in range(i):
            shared = [f"v{v}" for v in sorted(d.bags[i] & d.bags[j])]
            if shared:
                frames[j] = frames[j].join(frames[i].select(*shared).distinct(), shared, "left_semi")
    return frames


def count(g: Graph, p: Pattern, d: Decomposition | None = None) -> DataFrame:
    return matches(g, p, d).agg(F.count("*").alias("n_matches"))
