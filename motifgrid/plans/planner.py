"""Choosing a strategy by estimated rows, and saying why."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import functions as F

from ..model import Graph, Stats
from ..operators import array_extend, closed_form, kernel
from .decompose import Decomposition, decompositions
from .pattern import Pattern, reduce_rules

#: Weight of a row that is written to a shuffle against one that is only produced.
SHUFFLE_WEIGHT = 20
SAMPLE_VERTICES = 1 / 64


@dataclass
class Plan:
    strategy: str
    order: list[int]
    rules: list[tuple[int, int]]
    costs: dict[str, float]
    bags: list[list[int]] = field(default_factory=list)
    width: float = 0.0

    def text(self) -> str:
        """The report: strategy, order, final rules, bags and costs."""
        lines = [f"strategy: {self.strategy}", f"order: {' '.join(map(str, self.order))}", "rules: " + (", ".join(f"{a}<{b}" for a, b in self.rules) or "none")]
        if self.bags:
            lines.append(f"bags (width {self.width:g}): " + " | ".join(",".join(map(str, b)) for b in self.bags))
        return "\n".join([*lines, *(f"cost {k}: {v:.3g}" for k, v in sorted(self.costs.items(), key=lambda x: x[1]))])


def prefix_rows(p: Pattern, order: list[int], s: Stats) -> list[float]:
    """Estimated matches of each prefix, from degree moments: a step to one
    neighbour multiplies by the mean degree of an edge's end, each further
    neighbour by the chance of an edge."""
    rows = [float(s.vertices)]
    end = 2 * s.wedges / max(1, 2 * s.edges) + 1
    chance = min(1.0, 4 * s.mean_degree / max(1, s.vertices))
    for i in range(1, len(order)):
        back = sum(u in p.adjacent[order[i]] for u in order[:i])
        rows.append(rows[-1] * end * chance ** max(0, back - 1))
    return rows


def sampled_rows(g: Graph, p: Pattern, order: list[int], fraction: float = SAMPLE_VERTICES, seed: int = 7) -> float:
    """Ordered matches of the pattern's order, scaled up from a seeded sample of first vertices."""
    name = f"v{order[0]}"
    found = array_extend.matches(g, p, order, rules=[])
    cut = F.pmod(F.xxhash64(F.lit(seed), F.col(name)), F.lit(1 << 20)) < int(fraction * (1 << 20))
    return found.where(cut).count() / fraction


def extend_cost(p: Pattern, order: list[int], s: Stats, rules: int) -> float:
    rows = prefix_rows(p, order, s)
    return sum(r * (SHUFFLE_WEIGHT + s.mean_degree) for r in rows[1:-1]) / (1 + rules) + s.edges


def bags_cost(p: Pattern, d: Decomposition, s: Stats) -> float:
    total = 0.0
    for bag in d.bags:
        q = p.induced(bag)
        rows = prefix_rows(q, q.order(), s)
        total += sum(rows) + rows[-1] * SHUFFLE_WEIGHT
    have: set[int] = set()
    for bag in d.bags[:-1]:
        have |= bag
        q = p.induced(have) if p.connected(have) else p
        total += prefix_rows(q, q.order(), s)[-1] * SHUFFLE_WEIGHT
    return total


def plan(g: Graph, p: Pattern, strategy: str = "auto", order: list[int] | None = None, bags=None) -> Plan:
    """The cheapest strategy, or the one asked for; ``order`` and ``bags`` are hints that are kept."""
    order = order or p.order()
    rules = reduce_rules(p.rules(first=order))
    costs: dict[str, float] = {}
    s = g.stats
    costs["array_extend"] = extend_cost(p, order, s, len(rules))
    tree = None
    if p.n > 2 and (bags or p.n <= 8):
        tree = Decomposition(tuple(map(frozenset, bags)), max(p.width(b) for b in bags)) if bags else min(decompositions(p), key=lambda d: bags_cost(p, d, s))
        if len(tree.bags) > 1:
            costs["bags"] = bags_cost(p, tree, s)
    if closed_form.formula_for(p):
        costs["closed_form"] = s.wedges + s.edges
    if kernel.fits(g) and p.n > 1 and costs["array_extend"] < 1e6:
        costs["kernel"] = costs["array_extend"] / 2
    chosen = strategy if strategy != "auto" else min(costs, key=costs.get)
    return Plan(chosen, order, rules, costs, [sorted(b) for b in tree.bags] if tree else [], tree.width if tree else 0.0)


def read_plan(path: str | Path) -> list[frozenset[int]]:
    """Bags from a file: one per line, vertices separated by commas, the join root last; root first here."""
    lines = [x for x in Path(path).read_text().splitlines() if x.strip()]
    return [frozenset(int(v) for v in x.split(",") if v.strip()) for x in reversed(lines)]


def save_stats(s: Stats, path: str | Path) -> None:
    Path(path).write_text(json.dumps(asdict(s)))


def load_stats(path: str | Path) -> Stats:
    return Stats(**json.loads(Path(path).read_text()))
