"""Cutting stock by column generation, over a histogram of lengths.

Everything here works on counts per length class, never on documents: the
size of the linear program is bounded by the number of classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Relative gap between the program's value and its bound at which columns stop coming in.
GAP = 3e-3
#: Patterns that leave more than this share empty give their pieces back, to be cut in two where that helps.
WASTE = 0.01


@dataclass
class Plan:
    """``splits[c]`` pieces of class c are cut in two; then ``patterns`` (class -> pieces, times) cover all."""

    splits: dict[int, int]
    patterns: list[tuple[dict[int, int], int]]


def knapsack(values: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of items within the capacity (dynamic programming over it)."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    useful = np.flatnonzero(values > 1e-12)
    v, w = values[useful], weights[useful]
    counts = np.zeros(len(values), np.int64)
    if not len(useful):
        return 0.0, counts
    for c in range(1, capacity + 1):
        best[c], choice[c] = best[c - 1], -2
        fit = np.searchsorted(w, c, "right")
        if fit:
            got = best[c - w[:fit]] + v[:fit]
            k = int(got.argmax())
            if got[k] > best[c] + 1e-15:
                best[c], choice[c] = got[k], k
    c = capacity
    while c > 0 and choice[c] != -1:
        if choice[c] == -2:
            c -= 1
        else:
            counts[useful[choice[c]]] += 1
            c -= w[choice[c]]
    return float(best[capacity]), counts


def _program(demand: np.ndarray, weights: np.ndarray, capacity: int, halves: dict[int, tuple[int, int]]):
    """Fractional times of each column: revised simplex, columns priced by the knapsack."""
    m = len(demand)
    rng = np.random.default_rng(7)
    need = demand + rng.uniform(0, 1e-4, m)  # keeps vertices from coinciding
    fit = capacity // weights
    columns = [("p", row) for row in np.diag(fit)]
    cost = np.ones(m)
    inverse = np.diag(1.0 / fit)
    x = need / fit
    split_rows = sorted(halves)
    for step in range(1, 12 * m + 1000):
        price = np.einsum("i,ij->j", cost, inverse)
        column, c = None, 0.0
        # A slot may stay empty or hold the next smaller class; a piece may be cut.
        gains = [-price, price[:-1] - price[1:], np.array([price[i] - price[halves[i][0]] - price[halves[i][1]] for i in split_rows])]
        kind, k = max(((g, int(v.argmax())) for g, v in enumerate(gains) if len(v)), key=lambda t: gains[t[0]][t[1]])
        if gains[kind][k] > 1e-7:
            column = np.zeros(m)
            if kind == 0:
                column[k] = -1
                entry = ("surplus", k)
            elif kind == 1:
                column[k], column[k + 1] = 1, -1
                entry = ("smaller", k)
            else:
                i = split_rows[k]
                column[i] += 1
                for h in halves[i]:
                    column[h] -= 1
                entry = ("s", i)
        if column is None:
            value, counts = knapsack(price, weights, capacity)
            if value <= 1 + GAP:
                break
            column, c, entry = counts.astype(float), 1.0, ("p", counts)
        direction = np.einsum("ij,j->i", inverse, column)
        positive = direction > 1e-9
        if not positive.any():
            break
        ratio = np.full(m, np.inf)
        ratio[positive] = x[positive] / direction[positive]
        out = int(ratio.argmin())
        x = x - ratio[out] * direction
        x[out] = ratio[out]
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        columns[out], cost[out] = entry, c
        if step % 500 == 0:  # one Newton step takes back the rounding errors of the updates
            basis = np.zeros((m, m))
            for j, (kind, what) in enumerate(columns):
                if kind == "p":
                    basis[:, j] = what
                elif kind == "surplus":
                    basis[what, j] = -1
                elif kind == "smaller":
                    basis[what, j], basis[what + 1, j] = 1, -1
                else:
                    basis[what, j] += 1
                    for h in halves[what]:
                        basis[h, j] -= 1
            error = np.einsum("ij,jk->ik", basis, inverse)
            inverse = 2 * inverse - np.einsum("ij,jk->ik", inverse, error)
            x = np.einsum("ij,j->i", inverse, need)
    return columns, np.maximum(x, 0)


def _fill(left: dict[int, int], capacity: int) -> dict[int, int]:
    """One sequence of what is left: the largest piece, then the best sum of others.

    Reachable sums are bits of an integer; counts go in as powers of two.
    """
    first = max(left)
    pattern = {first: 1}
    room = capacity - first
    steps, bits = [], 1
    mask = (1 << (room + 1)) - 1
    for w in sorted(left, reverse=True):
        n = min(left[w] - (w == first), room // w)
        k = 1
        while n > 0:
            k = min(k, n)
            steps.append((w, k, bits))
            bits |= (bits << (w * k)) & mask
            n -= k
            k *= 2
    at = bits.bit_length() - 1
    for w, k, before in reversed(steps):
        if not before >> at & 1:
            pattern[w] = pattern.get(w, 0) + k
            at -= w * k
    return pattern


def _rounded(columns, x, rows: list[int], left: dict[int, int], least: float) -> list[tuple[dict[int, int], int]]:
    """Whole times of the patterns that weigh ``least`` or more, the most used first; takes them from ``left``."""
    out = []
    order = sorted((j for j, (kind, _) in enumerate(columns) if kind == "p"), key=lambda j: -x[j])
    for j in order:
        pattern = {rows[i]: int(a) for i, a in enumerate(columns[j][1]) if a}
        times = min(int(x[j] + 1e-6), *[left.get(w, 0) // a for w, a in pattern.items()])
        if times and sum(w * a for w, a in pattern.items()) >= least:
            out.append((pattern, times))
            _take(left, pattern, times)
    return out


def _take(left: dict[int, int], pattern: dict[int, int], times: int) -> None:
    for w, a in pattern.items():
        left[w] -= a * times
        if not left[w]:
            del left[w]


def solve(histogram: dict[int, int], capacity: int, halves: dict[int, tuple[int, int]] | None = None) -> Plan:
    """Cover every class's count exactly.

    ``histogram`` maps a weight (1..capacity) to its pieces. ``halves`` names
    weights that may be cut into two given ones. Whole pieces come first; what
    they cannot fill well goes through a second program that may cut. Program
    values are rounded down, and the few pieces left over (about one pattern
    per class) are then filled into sequences one by one.
    """
    left = {w: int(n) for w, n in histogram.items() if n}
    patterns: list[tuple[dict[int, int], int]] = []
    splits: dict[int, int] = {}
    for cutting in (False, True):
        cuts = {c: p for c, p in (halves or {}).items() if cutting and c in left}
        rows = sorted({*left, *[h for p in cuts.values() for h in p]})
        if not rows or (cutting and not cuts):
            continue
        at = {w: i for i, w in enumerate(rows)}
        demand = np.array([left.get(w, 0) for w in rows], float)
        columns, x = _program(demand, np.array(rows), capacity, {at[c]: (at[a], at[b]) for c, (a, b) in cuts.items()})
        for (kind, what), t in zip(columns, x, strict=True):
            if kind == "s" and (n := min(int(t + 1e-6), histogram.get(rows[what], 0), left.get(rows[what], 0))):
                splits[rows[what]] = n
        for w, n in splits.items():
            for h in cuts[w]:
                left[h] = left.get(h, 0) + n
            _take(left, {w: 1}, n)
        patterns += _rounded(columns, x, rows, left, 0 if cutting else capacity * (1 - WASTE))
    while left:
        pattern = _fill(left, capacity)
        times = min(left[w] // a for w, a in pattern.items())
        patterns.append((pattern, times))
        _take(left, pattern, times)
    return Plan(splits, patterns)
