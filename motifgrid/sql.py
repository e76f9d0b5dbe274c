"""SQL surface: a table function that matches a pattern over an edge table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .plans.pattern import Pattern


@udtf(returnType="pattern string, vertices int, edges int, automorphisms long, rules string, width double")
class PatternInfo:
    """``select * from pattern_info('4 4 0 1 1 2 2 3 0 3')``."""

    def eval(self, text: str):
        from .plans.decompose import decompositions

        p = Pattern.parse(text)
        rules = ",".join(f"{a}<{b}" for a, b in p.rules())
        yield text, p.n, len(p.edges), len(p.automorphisms), rules, float(decompositions(p)[0].width) if p.n > 1 else 1.0


@udtf(returnType="vertices array<bigint>")
class GraphMatch:
    """Matches in each partition of a table ``(pattern, u, v)``; meant for many small graphs,
    as in ``graph_match(table(...) partition by graph_id)``."""

    def __init__(self):
        self.pattern, self.pairs = "", []

    def eval(self, row):
        self.pattern = row["pattern"]
        if row["u"] != row["v"]:
            self.pairs.append((row["u"], row["v"]))

    def terminate(self):
        if not self.pattern:
            return
        p = Pattern.parse(self.pattern)
        order = p.order()
        rules = set(p.rules(first=order))
        near: dict[int, set[int]] = {}
        for u, v in self.pairs:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)

        def extend(bound: dict[int, int]):
            if len(bound) == p.n:
                yield ([bound[i] for i in range(p.n)],)
                return
            v = order[len(bound)]
            back = [bound[u] for u in bound if u in p.adjacent[v]]
            for x in sorted(set.intersection(*[near[b] for b in back]) if back else near):
                if x not in bound.values() and all(bound[u] < x for u in bound if (u, v) in rules) and all(x < bound[u] for u in bound if (v, u) in rules):
                    yield from extend({**bound, v: x})

        yield from extend({})


def register_sql_functions(spark: SparkSession) -> None:
    spark.udtf.register("pattern_info", PatternInfo)
    spark.udtf.register("graph_match", GraphMatch)
