"""Worst-case-optimal style matching: one vertex at a time, candidates by intersecting neighbour arrays.

A bound vertex carries its neighbour array as long as a later vertex needs
it, so a step is at most one equi-join on the new vertex and an
intersection; wedges are never listed. Where a later vertex needs all arrays
of an earlier one, the earlier intersection goes along in their place and is
only narrowed. The last vertex is counted, not listed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bounded, choose, intersect
from ..model import Graph
from ..plans.pattern import Pattern, reduce_rules


def _seed(g: Graph, p: Pattern, order: list[int]) -> DataFrame:
    v = order[0]
    return g.adj.where(F.col("deg") >= len(p.adjacent[v])).select(F.col("u").alias(f"v{v}"), F.col("nb").alias(f"n{v}"))


def _reuse(p: Pattern, order: list[int]) -> dict[int, tuple[frozenset[int], frozenset[int], frozenset[int]]]:
    """For each vertex after the first: its placed neighbours, the largest part
    of them (two or more) that an earlier vertex had for its own, and the rest."""
    out: dict[int, tuple[frozenset[int], frozenset[int], frozenset[int]]] = {}
    for at, v in enumerate(order[1:], 1):
        back = frozenset(p.adjacent[v]) & set(order[:at])
        ready = max((b for b, _, _ in out.values() if len(b) > 1 and b <= back), key=len, default=frozenset())
        out[v] = back, ready, back - ready
    return out


def _name(back: frozenset[int]) -> str:
    """The column of an intersection that is kept."""
    return "i" + "_".join(map(str, sorted(back)))


def _intersection(df: DataFrame, use: tuple[frozenset[int], frozenset[int], frozenset[int]]) -> Column:
    back, ready, rest = use
    if len(back) > 1 and _name(back) in df.columns:
        return F.col(_name(back))
    return intersect([*([F.col(_name(ready))] if ready else []), *[F.col(f"n{u}") for u in sorted(rest)]])


def _candidates(df: DataFrame, p: Pattern, order: list[int], at: int, rules: set[tuple[int, int]]) -> Column:
    """Candidates of ``order[at]``: the largest intersection already made, and the arrays that it lacks."""
    v, placed = order[at], order[:at]
    use = _reuse(p, order)[v]
    above = [F.col(f"v{u}") for u in placed if (u, v) in rules]
    below = [F.col(f"v{u}") for u in placed if (v, u) in rules]
    other = [F.col(f"v{u}") for u in placed if u not in use[0] and (u, v) not in rules and (v, u) not in rules]
    return bounded(_intersection(df, use), above, below, other)


def _extend(g: Graph, p: Pattern, order: list[int], upto: int, rules: set[tuple[int, int]]) -> DataFrame:
    """Matches of the first ``upto`` vertices, with the arrays and intersections that later ones need."""
    df = _seed(g, p, order)
    uses = _reuse(p, order)
    adj = g.adj.select(F.col("u").alias("_u"), F.col("nb").alias("_nb"), F.col("deg").alias("_deg"))
    for at in range(1, upto):
        v = order[at]
        later = [uses[w] for w in order[at + 1 :]]
        back = uses[v][0]
        if any(back == ready for _, ready, _ in later) and _name(back) not in df.columns:
            df = df.withColumn(_name(back), _intersection(df, uses[v]))
        df = df.withColumn(f"v{v}", F.explode(_candidates(df, p, order, at, rules)))
        alive = {f"n{u}" for _, _, rest in later for u in rest} | {_name(ready) for _, ready, _ in later if ready}
        df = df.drop(*[c for c in df.columns if c[0] in "ni" and c not in alive])
        if f"n{v}" in alive:
            own = adj.where(F.col("_deg") >= len(p.adjacent[v])).select("_u", F.col("_nb").alias(f"n{v}"))
            df = df.join(own, F.col(f"v{v}") == F.col("_u")).drop("_u")
    return df


def matches(g: Graph, p: Pattern, order: list[int] | None = None, rules=None) -> DataFrame:
    """Every subgraph once, as ``v0..v{k-1}``."""
    order = order or p.order()
    rules = set(reduce_rules(p.rules(first=order) if rules is None else rules))
    df = _extend(g, p, order, p.n, rules) if p.n > 1 else g.vertices.select(F.col("v").alias("v0"))
    return df.select(*[f"v{i}" for i in range(p.n)])


def count(g: Graph, p: Pattern, order: list[int] | None = None, rules=None) -> DataFrame:
    """``n_matches``; the last vertex's candidates are only counted."""
    order = order or p.order()
    rules = set(reduce_rules(p.rules(first=order) if rules is None else rules))
    if p.n == 1:
        return g.vertices.agg(F.count("*").alias("n_matches"))
    df = _extend(g, p, order, p.n - 1, rules)
    last = F.size(_candidates(df, p, order, p.n - 1, rules)).cast("long")
    return df.agg(F.coalesce(F.sum(last), F.lit(0)).cast("long").alias("n_matches"))


def twin_leaves(p: Pattern) -> frozenset[int]:
    """The largest set of mutually non-adjacent vertices with the same neighbours."""
    groups: dict[frozenset[int], set[int]] = {}
    for v in range(p.n):
        groups.setdefault(p.adjacent[v], set()).add(v)
    best = max(groups.values(), key=lambda s: (len(s), -min(s)))
    return frozenset(best if len(best) > 1 and len(best) < p.n else ())


def count_twins(g: Graph, p: Pattern) -> DataFrame:
    """Count with the twins chosen, not listed: C(n, k) for k vertices of n common candidates.

    The rest H is matched up to the automorphisms that keep the twins as a
    set; the sum times k! times their number on H, over all automorphisms, is
    the count.
    """
    twins = twin_leaves(p)
    rest = [v for v in range(p.n) if v not in twins]
    if not twins or not p.connected(rest):
        return count(g, p)
    keep = {tuple(a[v] for v in rest) for a in p.automorphisms if {a[t] for t in twins} == twins}
    at = {v: i for i, v in enumerate(rest)}
    h = p.induced(rest)
    group = [tuple(at[w] for w in k) for k in keep]
    order = h.order()
    rules = set(reduce_rules(h.rules(group, first=order)))
    near = sorted(p.adjacent[min(twins)])
    df = matches(g, h, order, rules)
    for u in near:
        own = g.adj.select(F.col("u").alias("_u"), F.col("nb").alias(f"n{u}"))
        df = df.join(own, F.col(f"v{at[u]}") == F.col("_u")).drop("_u")
    others = [F.col(f"v{at[v]}") for v in rest if v not in near]
    n = F.size(bounded(intersect([F.col(f"n{u}") for u in near]), other_than=others))
    top, bottom = math.factorial(len(twins)) * len(keep), len(p.automorphisms)
    total = F.coalesce(F.sum(choose(n, len(twins))), F.lit(0))
    return df.agg(F.call_function("div", total * top, F.lit(bottom).cast("long")).cast("long").alias("n_matches"))
