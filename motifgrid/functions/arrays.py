"""Column functions on sorted neighbour arrays; all of them stay in the JVM."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersect(arrays: list[Column]) -> Column:
    """k-way intersection."""
    return functools.reduce(F.array_intersect, arrays)


def bounded(candidates: Column, above: Iterable[Column] = (), below: Iterable[Column] = (), other_than: Iterable[Column] = ()) -> Column:
    """Candidates over every lower bound, under every upper one, and none of the given vertices."""
    above, below, other_than = list(above), list(below), list(other_than)
    if not (above or below or other_than):
        return candidates
    low = F.greatest(*above) if len(above) > 1 else above[0] if above else None
    high = F.least(*below) if len(below) > 1 else below[0] if below else None

    def keep(x: Column) -> Column:
        tests = [x > low] if low is not None else []
        tests += [x < high] if high is not None else []
        tests += [x != v for v in other_than]
        return functools.reduce(lambda a, b: a & b, tests)

    return F.filter(candidates, keep)


def choose(n: Column, k: int) -> Column:
    """C(n, k) in whole numbers: each partial product is itself a binomial, so every division is exact."""
    n = n.cast("long")
    out = F.lit(1).cast("long")
    for i in range(k):
        out = F.call_function("div", out * (n - i), F.lit(i + 1).cast("long")) if i else n
    return F.when(n >= k, out).otherwise(F.lit(0).cast("long"))


def distinct_pairs(a: Column, b: Column) -> Column:
    """Ordered pairs of different members, one of each array, by inclusion and exclusion."""
    return F.size(a).cast("long") * F.size(b) - F.size(F.array_intersect(a, b))


def distinct_triples(a: Column, b: Column, c: Column) -> Column:
    """Triples of different members, one of each array, by inclusion and exclusion."""
    n = lambda x: F.size(x).cast("long")
    two = lambda x, y: n(F.array_intersect(x, y))
    three = n(intersect([a, b, c]))
    return n(a) * n(b) * n(c) - two(a, b) * n(c) - two(a, c) * n(b) - two(b, c) * n(a) + three * 2


def nested_chain(arrays: list[Column]) -> Column:
    """Tuples of different members where each array contains the one before: prod(size - i)."""
    return functools.reduce(lambda x, y: x * y, [F.greatest(F.size(a).cast("long") - i, F.lit(0)) for i, a in enumerate(arrays)])
