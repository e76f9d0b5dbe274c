"""Patterns: parsing, symmetry, orders and width."""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass, field
from pathlib import Path

MAX_VERTICES = 32


@dataclass(frozen=True)
class Pattern:
    """A small connected undirected graph on ``0..n-1``."""

    n: int
    edges: frozenset[tuple[int, int]]
    orbit: tuple[int, ...] = ()
    labels: tuple[int, ...] = field(default=())

    def __post_init__(self) -> None:
        if not 1 <= self.n <= MAX_VERTICES:
            raise ValueError(f"a pattern has 1 to {MAX_VERTICES} vertices, not {self.n}")
        if any(not 0 <= a < b < self.n for a, b in self.edges):
            raise ValueError("a pattern's edges are pairs of different vertices below n, smaller first")
        if not self.connected(range(self.n)):
            raise ValueError("a pattern must be connected")

    @classmethod
    def of(cls, edges, n: int | None = None, labels=()) -> Pattern:
        pairs = frozenset((min(a, b), max(a, b)) for a, b in edges if a != b)
        return cls(n or 1 + max(b for _, b in pairs), pairs, (), tuple(labels))

    @classmethod
    def parse(cls, text: str) -> Pattern:
        """``n m``, m edges, and none, ``1 v`` or ``2 u v`` as orbit; any white space separates."""
        numbers = [int(t) for t in text.split()]
        if len(numbers) < 2 or len(numbers) < 2 + 2 * numbers[1]:
            raise ValueError("a pattern needs 'n m' and m edges")
        n, m = numbers[:2]
        flat, rest = numbers[2 : 2 + 2 * m], numbers[2 + 2 * m :]
        if rest and not (rest[0] in (1, 2) and len(rest) == 1 + rest[0] and all(0 <= v < n for v in rest[1:])):
            raise ValueError("an orbit is '1 v' or '2 u v'")
        return cls(n, cls.of(zip(flat[::2], flat[1::2], strict=True), n).edges, tuple(rest[1:]))

    @classmethod
    def load(cls, path: str | Path) -> Pattern:
        return cls.parse(Path(path).read_text())

    @functools.cached_property
    def adjacent(self) -> tuple[frozenset[int], ...]:
        near: list[set[int]] = [set() for _ in range(self.n)]
        for a, b in self.edges:
            near[a].add(b)
            near[b].add(a)
        return tuple(map(frozenset, near))

    def connected(self, part) -> bool:
        part = set(part)
        seen, todo = set(), [min(part)]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += self.adjacent[v] & part
        return seen == part

    def distances(self) -> list[list[int]]:
        """Shortest paths, in edges."""
        out = []
        for s in range(self.n):
            far = {s: 0}
            ring = [s]
            while ring:
                ring = [w for v in ring for w in self.adjacent[v] if w not in far and not far.update({w: far[v] + 1})]
            out.append([far[v] for v in range(self.n)])
        return out

    def induced(self, part) -> Pattern:
        """The part's pattern, its vertices renumbered in ascending order."""
        at = {v: i for i, v in enumerate(sorted(part))}
        return Pattern(len(at), frozenset((at[a], at[b]) for a, b in self.edges if a in at and b in at))

    # Symmetry

    @functools.cached_property
    def automorphisms(self) -> tuple[tuple[int, ...], ...]:
        return tuple(self._maps(self))

    def _maps(self, other: Pattern):
        """Isomorphisms onto another pattern, by backtracking over equal degrees and labels."""
        sign = lambda p, v: (len(p.adjacent[v]), p.labels[v] if p.labels else 0)

        def extend(image: list[int]):
            v = len(image)
            if v == self.n:
                yield tuple(image)
                return
            for w in range(self.n):
                if w not in image and sign(self, v) == sign(other, w) and all((u in self.adjacent[v]) == (image[u] in other.adjacent[w]) for u in range(v)):
                    yield from extend([*image, w])

        if self.n == other.n and len(self.edges) == len(other.edges):
            yield from extend([])

    def isomorphism(self, other: Pattern) -> tuple[int, ...] | None:
        return next(self._maps(other), None)

    @functools.cached_property
    def canonical(self) -> tuple:
        """Equal for isomorphic patterns and for no others."""
        near = self.adjacent
        color = [(len(near[v]), self.labels[v] if self.labels else 0) for v in range(self.n)]
        for _ in range(self.n):  # refine by neighbours
            full = [(color[v], tuple(sorted(color[w] for w in near[v]))) for v in range(self.n)]
            ids = {c: i for i, c in enumerate(sorted(set(full)))}
            color = [(ids[c], 0) for c in full]
        groups = [[v for v in range(self.n) if color[v] == c] for c in sorted(set(color))]
        best = None
        for parts in itertools.product(*map(itertools.permutations, groups)):
            at = {v: i for i, v in enumerate(itertools.chain(*parts))}
            form = tuple(sorted((min(at[a], at[b]), max(at[a], at[b])) for a, b in self.edges))
            best = form if best is None else min(best, form)
        return self.n, best, tuple(sorted(self.labels))

    def orbits(self, group=None) -> list[frozenset[int]]:
        group = self.automorphisms if group is None else group
        return sorted({frozenset(g[v] for g in group) for v in range(self.n)}, key=min)

    def rules(self, group=None, first=()) -> list[tuple[int, int]]:
        """Pairs (a, b) for ``m(a) < m(b)`` that leave one match per subgraph.

        The group's orbits are broken one after another, each by its vertex
        that comes earliest in ``first`` (then the least), down the chain of
        stabilisers.
        """
        group = list(self.automorphisms if group is None else group)
        place = {v: i for i, v in enumerate(first)}
        out = []
        while len(group) > 1:
            orbit = min((o for o in self.orbits(group) if len(o) > 1), key=lambda o: min((place.get(v, 99), v) for v in o))
            u = min(orbit, key=lambda v: (place.get(v, 99), v))
            out += [(u, w) for w in sorted(orbit) if w != u]
            group = [g for g in group if g[u] == u]
        return out

    def rule_sets(self, most: int = 1000) -> list[frozenset[tuple[int, int]]]:
        """Rule sets for every choice of orbit and representative along the chain, without repeats."""
        found: set[frozenset] = set()
        todo = [(list(self.automorphisms), frozenset())]
        while todo and len(found) < most:
            group, rules = todo.pop()
            moved = [o for o in self.orbits(group) if len(o) > 1]
            if not moved:
                found.add(rules)
            for orbit in moved:
                for u in orbit if len(orbit) > 2 else [min(orbit)]:
                    todo.append(([g for g in group if g[u] == u], rules | {(u, w) for w in orbit if w != u}))
        return sorted(found, key=sorted)

    # Structure

    @functools.cached_property
    def core(self) -> frozenset[int]:
        """The 2-core: what is left when vertices of degree 1 keep going."""
        left = set(range(self.n))
        while ends := {v for v in left if len(self.adjacent[v] & left) < 2}:
            left -= ends
        return frozenset(left)

    def order(self, part=None, start=()) -> list[int]:
        """Matching order: most placed neighbours, then most neighbours next to placed ones, then degree, then id."""
        part = set(range(self.n)) if part is None else set(part)
        out = list(start)
        while len(out) < len(part):
            placed = set(out)
            rest = part - placed

            def rank(v: int, placed=placed, rest=rest) -> tuple:
                near = self.adjacent[v]
                touching = sum(1 for w in near & rest if self.adjacent[w] & placed)
                return (len(near & placed), touching, len(near & part), -v)

            reach = [v for v in rest if not placed or self.adjacent[v] & placed] or list(rest)
            out.append(max(reach, key=rank))
        return out

    def width(self, bag) -> float:
        """Fractional edge cover number of a bag's induced graph: its size less
        half a maximum matching of the bipartite double cover."""
        bag = sorted(bag)
        inside = set(bag)
        partner: dict[int, int] = {}

        def augment(v: int, seen: set[int]) -> bool:
            for w in self.adjacent[v] & inside:
                if w not in seen:
                    seen.add(w)
                    if w not in partner or augment(partner[w], seen):
                        partner[w] = v
                        return True
            return False

        return len(bag) - sum(augment(v, set()) for v in bag) / 2

    @property
    def is_clique(self) -> bool:
        return len(self.edges) == self.n * (self.n - 1) // 2


def reduce_rules(rules) -> list[tuple[int, int]]:
    """Rules without those that follow from two others."""
    rules = set(rules)
    return sorted((a, b) for a, b in rules if not any((a, c) in rules and (c, b) in rules for c in {x for r in rules for x in r}))


def load_directory(path: str | Path) -> dict[str, Pattern]:
    """All patterns of a folder, by descending file name."""
    return {p.name: Pattern.load(p) for p in sorted(Path(path).glob("*.txt"), reverse=True)}
