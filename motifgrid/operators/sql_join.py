"""One self-join of the edge relation per pattern edge, with the symmetry rules as predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..plans.pattern import Pattern, reduce_rules


def matches(g: Graph, p: Pattern, rules=None) -> DataFrame:
    """``v0..v{k-1}``, each subgraph once: rules are ``<``, other non-adjacent pairs ``<>``.

    A pattern edge whose ends a rule orders reads the one-way edge table.
    """
    order = p.order()
    rules = set(p.rules(first=order) if rules is None else rules)
    out: DataFrame | None = None
    placed: list[int] = []
    for v in order:
        back = [u for u in placed if u in p.adjacent[v]]
        for i, u in enumerate(back):
            up, down = (u, v) in rules, (v, u) in rules
            step = g.edge_relation(1 if up else 2 if down else 0).toDF(f"v{u}", f"v{v}")
            keys = [f"v{u}"] if i == 0 else [f"v{u}", f"v{v}"]
            out = step if out is None else out.join(step, keys)
        for u in placed:
            a, b = F.col(f"v{u}"), F.col(f"v{v}")
            if (u, v) in rules and u not in back:
                out = out.where(a < b)
            elif (v, u) in rules and u not in back:
                out = out.where(b < a)
            elif u not in back:
                out = out.where(a != b)
        placed.append(v)
    if out is None:
        out = g.vertices.select(F.col("v").alias("v0"))
    return out.select(*[f"v{i}" for i in range(p.n)])


def sql_text(p: Pattern, edges: str = "e", sym: str = "s") -> str:
    """The same join as SQL text over tables ``e(u, v)`` with u < v and ``s(u, v)`` both ways."""
    rules = set(reduce_rules(p.rules()))
    tables, tests, first = [], [], {}
    for i, (a, b) in enumerate(sorted(p.edges)):
        up = (a, b) in rules
        tables.append(f"{edges if up else sym} t{i}")
        for v, c in ((a, "u"), (b, "v")):
            if v in first:
                tests.append(f"t{i}.{c} = {first[v]}")
            else:
                first[v] = f"t{i}.{c}"
    for a in range(p.n):
        for b in range(a + 1, p.n):
            if (a, b) in rules and (a, b) not in p.edges:
                tests.append(f"{first[a]} < {first[b]}")
            elif (b, a) in rules:
                tests.append(f"{first[b]} < {first[a]}")
            elif (a, b) not in p.edges and (a, b) not in rules:
                tests.append(f"{first[a]} <> {first[b]}")
    cols = ", ".join(f"{first[v]} v{v}" for v in range(p.n))
    return f"select {cols} from {', '.join(tables)}" + (f" where {' and '.join(tests)}" if tests else "")
