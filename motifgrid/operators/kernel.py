"""Backtracking inside tasks over neighbour lists in memory, on whole arrays of partial matches.

A graph whose adjacency is under a checked size is broadcast, and a task
takes a block of edges. Of a larger graph, a task takes a block of first
vertices and gets just the lists that their matches can touch; what a block
may need is bounded beforehand, so its lists stay under the same size. The
planner asks ``fits`` and takes the kernel by itself only for the former.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph
from ..plans.pattern import Pattern
from ..shared import shared_folder

BUDGET = 64 << 20
#: Candidates that a task lists at once.
STEP = 1 << 20


def fits(g: Graph, budget: int = BUDGET) -> bool:
    """16 bytes per edge direction and vertex at most."""
    return 16 * (2 * g.stats.edges + g.stats.vertices) <= budget


def _depths(p: Pattern, order: list[int]) -> dict[int, int]:
    """Steps from the first vertex, along placed vertices only."""
    out = {order[0]: 0}
    for at, v in enumerate(order[1:], 1):
        out[v] = 1 + min(out[u] for u in order[:at] if u in p.adjacent[v])
    return out


def _held(p: Pattern, order: list[int]) -> list[int]:
    """Vertices after the first whose lists the search reads: those with a later neighbour."""
    return [v for at, v in enumerate(order) if at and p.adjacent[v] & set(order[at + 1 :])]


def _order(p: Pattern) -> list[int]:
    """The order that reads lists nearest to the first vertex, then places most neighbours early."""

    def rank(order: list[int]) -> tuple:
        depth = _depths(p, order)
        return sum(depth[v] for v in _held(p, order)), [-len(p.adjacent[v] & set(order[:at])) for at, v in enumerate(order)], order

    if p.n > 7:
        return min((p.order(start=[v]) for v in range(p.n)), key=rank)
    orders = map(list, itertools.permutations(range(p.n)))
    return min((o for o in orders if all(p.adjacent[v] & set(o[:at]) for at, v in enumerate(o) if at)), key=rank)


class _Search:
    """Neighbour lists as one sorted array of keys ``owner * n + member``; vertices go by their rank."""

    def __init__(self, owners: np.ndarray, sizes: np.ndarray, members: np.ndarray, p: Pattern, order: list[int], rules: set, pieces: int = 1, at: tuple = ()):
        """With ``pieces`` over 1, a held vertex counts only where its id modulo them is its place in ``at``."""
        self.ids = np.unique(np.concatenate([owners, members]))
        self.n = max(1, len(self.ids))
        self.keys = np.repeat(self.rank(owners), sizes) * self.n + self.rank(members)
        self.keys.sort()
        self.p, self.order, self.rules, self.pieces = p, order, rules, pieces
        self.at = dict(zip(_held(p, order), at))

    def rank(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)

    def count(self, bound: dict[int, np.ndarray]) -> int:
        """Matches that extend any row of the placed vertices' columns."""
        rows = len(bound[self.order[0]])
        if len(bound) == self.p.n or not rows:
            return rows
        v = self.order[len(bound)]
        low = np.zeros(rows, np.int64)
        high = np.full(rows, self.n, np.int64)
        for u, x in bound.items():
            if (u, v) in self.rules:
                low = np.maximum(low, x + 1)
            if (v, u) in self.rules:
                high = np.minimum(high, x)
        high = np.maximum(low, high)
        near = [u for u in bound if u in self.p.adjacent[v]]
        first = np.stack([np.searchsorted(self.keys, bound[u] * self.n + low) for u in near])
        size = np.stack([np.searchsorted(self.keys, bound[u] * self.n + high) for u in near]) - first
        pick = size.argmin(0)
        total = 0
        for k, u in enumerate(near):
            mine = np.flatnonzero((pick == k) & (size[k] > 0))
            ends = np.cumsum(size[k][mine])
            start = 0
            while start < len(mine):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + STEP, "right")))
                total += self._step(bound, v, mine[start:stop], first[k], size[k], [w for w in near if w != u])
                start = stop
        return total

    def _step(self, bound: dict[int, np.ndarray], v: int, rows: np.ndarray, first: np.ndarray, size: np.ndarray, others: list[int]) -> int:
        """Lists the candidates of these rows from one list, keeps those in the other lists, and goes on."""
        sizes = size[rows]
        row = np.repeat(rows, sizes)
        x = self.keys[np.arange(len(row)) + np.repeat(first[rows] - np.cumsum(sizes) + sizes, sizes)] % self.n
        if self.pieces > 1 and v in self.at:
            keep = self.ids[x] % self.pieces == self.at[v]
            row, x = row[keep], x[keep]
        for u in others:
            key = bound[u][row] * self.n + x
            keep = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
            row, x = row[keep], x[keep]
        for u in bound:
            if u not in self.p.adjacent[v] and (u, v) not in self.rules and (v, u) not in self.rules:
                keep = bound[u][row] != x
                row, x = row[keep], x[keep]
        if len(bound) == self.p.n - 1:
            return len(x)
        return self.count({**{u: y[row] for u, y in bound.items()}, v: x})


def _total(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_matches"))


def count(g: Graph, p: Pattern, budget: int = BUDGET) -> DataFrame:
    order = _order(p)
    rules = set(p.rules(first=order))
    return _broadcast(g, p, order, rules) if p.n > 1 and fits(g, budget) else _blocks(g, p, order, rules, budget)


def _broadcast(g: Graph, p: Pattern, order: list[int], rules: set) -> DataFrame:
    rows = g.sym.toPandas()
    shared = g.edges.sparkSession.sparkContext.broadcast((rows["u"].to_numpy(np.int64), rows["v"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = shared.value
        search = _Search(u, np.ones(len(u), np.int64), v, p, order, rules)
        a, b = order[:2]
        total = 0
        for batch in batches:
            x, y = (search.rank(batch.column(i).to_numpy()) for i in (0, 1))
            keep = x < y if (a, b) in rules else x > y if (b, a) in rules else x != y
            total += search.count({a: x[keep], b: y[keep]})
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    tasks = g.sym.select("u", "v").repartition(4 * g.edges.sparkSession.sparkContext.defaultParallelism, "u", "v")
    return _total(tasks.mapInArrow(run, "n long"))


def _first_blocks(g: Graph, p: Pattern, order: list[int], budget: int) -> DataFrame:
    """``(block, u)``: first vertices in blocks of half the budget each.

    A vertex's bound is the entries of the lists at the ends of all walks to
    its held vertices, at most the whole graph for each. One beyond half the
    budget by itself is split: each of its blocks takes one piece of the ids
    for every held vertex, and the blocks hold all combinations.
    """
    share = max(1, budget // 32)
    whole = F.lit(2.0 * g.stats.edges)
    depth, held = _depths(p, order), _held(p, order)
    walks = [g.degrees.select("u", F.col("deg").cast("double").alias("w0"))]
    for d in range(1, 1 + max((depth[v] for v in held), default=0)):
        near = g.sym.join(walks[-1].withColumnRenamed("u", "v"), "v")
        walks.append(near.groupBy("u").agg(F.sum(f"w{d - 1}").alias(f"w{d}")))
    rows = walks[0]
    for w in walks[1:]:
        rows = rows.join(w, "u")
    cost = F.col("w0")
    for v in held:
        cost = cost + F.least(F.col(f"w{depth[v]}"), whole)
    ranged = rows.select("u", cost.alias("cost")).repartitionByRange("u").withColumn("p", F.spark_partition_id())
    split = (F.col("cost") > share) if held else F.lit(False)
    up_to = F.sum(F.when(split, 0.0).otherwise(F.col("cost"))).over(Window.partitionBy("p").orderBy("u"))
    out = ranged.withColumn("q", F.when(~split, F.floor(up_to / share))).withColumn("pieces", F.when(split, F.ceil(F.col("cost") / share)).otherwise(1).cast("long"))
    for v in held:
        out = out.withColumn(f"at{v}", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    at = F.array(*[F.col(f"at{v}") for v in held]).cast("array<long>")
    # Written out: the partition numbers must be the same wherever the blocks are read.
    return out.select(F.struct("p", "q", F.when(F.col("q").isNull(), F.col("u")).alias("hub"), "pieces", at.alias("at")).alias("block"), "u").checkpoint()


def _blocks(g: Graph, p: Pattern, order: list[int], rules: set, budget: int) -> DataFrame:
    if p.n == 1:
        return g.vertices.agg(F.count("*").alias("n_matches"))
    shared_folder(g.edges.sparkSession)
    held, depth = _held(p, order), _depths(p, order)
    lists = g.adj.select("u", "nb")
    need = {order[0]: _first_blocks(g, p, order, budget)}
    for i, v in enumerate(held):
        back = min((u for u in order[: order.index(v)] if u in p.adjacent[v]), key=lambda u: (depth[u], order.index(u)))
        step = need[back].join(lists, "u").select("block", F.col("u").alias("x"), F.explode("nb").alias("u"))
        if (back, v) in rules:
            step = step.where("u > x")
        if (v, back) in rules:
            step = step.where("u < x")
        step = step.where(F.pmod("u", F.col("block.pieces")) == F.col("block.at")[i])
        need[v] = step.select("block", "u").distinct()
    touched = need[order[0]]
    for v in held:
        touched = touched.unionAll(need[v])
    rows = touched.distinct().join(lists, "u").select("block", "u", "nb")
    rows = rows.unionAll(need[order[0]].select("block", "u", F.lit(None).cast("array<long>").alias("nb")))

    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        have = table.filter(pc.is_valid(table["nb"]))
        nb = have["nb"].combine_chunks()
        search = _Search(have["u"].to_numpy(), pc.list_value_length(nb).to_numpy(zero_copy_only=False), pc.list_flatten(nb).to_numpy(zero_copy_only=False), p, order, rules, block["pieces"], block["at"])
        first = table.filter(pc.is_null(table["nb"]))["u"].to_numpy()
        return pa.table({"n": pa.array([search.count({order[0]: search.rank(first)})], pa.int64())})

    return _total(rows.groupBy("block").applyInArrow(run, "n long"))
