"""Connected components as DataFrame joins (alternating large and small stars)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import release, stage


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``(node, root)`` for every node of an edge; root is the component's least node.

    Edges may repeat, run both ways and contain loops; null ends are ignored.
    A round hangs each node on the least node it sees (large star, then small
    star), which ends in O(log^2 n) rounds whatever the shape.  Minima are
    taken with partial aggregation, so a hub costs one row per task; the edge
    set never grows, and each round ends in a staged table.  No edge list or
    label map reaches the driver: only a row count and a checksum do.
    """
    a, b = F.col(src), F.col(dst)
    clean = edges.where(a.isNotNull() & b.isNotNull())
    loops = clean.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    all_edges = stage(loops)
    current = all_edges.where("a <> b")
    seen = _fingerprint(current)
    while seen[0]:
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        last, current = current, stage(small)
        now = _fingerprint(current)
        release(last)
        if now == seen:
            break
        seen = now
    roots = current.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    nodes = all_edges.select(F.col("a").alias("node")).unionAll(all_edges.select(F.col("b").alias("node"))).distinct()
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


#: Edges that one task contracts, about.
CONTRACTED = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as (node, least node that they reach)."""
    up: dict = {}

    def root(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(up.setdefault(a, a)), root(up.setdefault(b, b))
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([root(v) for v in part], kind)], ["node", "root"])


def contracted_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """As ``connected_components``, for edges of which a large part closes
    circles: tasks of about a million edges each first reduce theirs to stars,
    and only the stars take part in the rounds. Where one task had all edges,
    its stars are the result."""
    a, b = F.col(src), F.col(dst)
    clean = edges.where(a.isNotNull() & b.isNotNull()).select(a.alias("node"), b.alias("root"))
    parts = 1 + clean.count() // CONTRACTED
    stars = clean.repartition(parts).mapInArrow(_contract, clean.schema)
    return stars if parts == 1 else connected_components(stars, "node", "root")
