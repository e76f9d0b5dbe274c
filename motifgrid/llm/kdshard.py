"""Sharding by a k-d tree over document metadata, in DataFrame operations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import gapless_rank, stage

#: Cells per histogram, and the share of a node's bytes within which a cut may miss its place.
CELLS = 2048
TOLERANCE = 1e-4
TIE_SPAN = 1 << 40


@dataclass
class Node:
    """Leaves ``[first, first + leaves)``; a cut sends rows below ``(value, tie)`` to the left."""

    first: int
    leaves: int
    where: Column | None = None
    dim: str = ""
    cut: tuple[int, int] = (0, 0)
    kids: list[Node] = field(default_factory=list)


def _below(dim: str, cut: tuple[int, int]) -> Column:
    value, tie = cut
    return (F.col(dim) < value) | ((F.col(dim) == value) & (F.col("tie") < tie))


def _locate(rows: DataFrame, key: dict[int, Column], spans: dict[int, list[int]], goal: dict[int, float], slack: dict[int, float]) -> dict[int, int]:
    """For each node the least ``x`` whose rows below weigh about ``goal``.

    Every round counts bytes in CELLS equal cells of each open node's span
    (at most CELLS rows a node reach the driver) and goes on in the cell that
    holds the goal, until that cell is light enough or one value wide.
    """
    found: dict[int, int] = {}
    open_ = dict(spans)
    base = dict.fromkeys(spans, 0.0)
    while open_:
        cell = F.lit(None).cast("struct<n:int,c:long>")
        for n, (lo, hi) in open_.items():
            step = (hi - lo) // CELLS + 1
            inside = (F.col("node") == n) & key[n].between(lo, hi)
            cell = F.when(inside, F.struct(F.lit(n).alias("n"), F.floor((key[n] - lo) / F.lit(step)).alias("c"))).otherwise(cell)
        seen = rows.select(cell.alias("cell"), "size").where("cell is not null").groupBy("cell").agg(F.sum("size").alias("w")).collect()
        by: dict[int, list[tuple[int, int]]] = {n: [] for n in open_}
        for r in seen:
            by[r["cell"]["n"]].append((r["cell"]["c"], r["w"]))
        for n, (lo, hi) in list(open_.items()):
            step, before = (hi - lo) // CELLS + 1, base[n]
            for c, w in sorted(by[n]):
                if before + w > goal[n]:
                    start, end = lo + c * step, min(hi, lo + (c + 1) * step - 1)
                    if w <= slack[n]:
                        found[n] = start if goal[n] - before <= before + w - goal[n] else end + 1
                    elif start == end:
                        found[n] = start
                    base[n], open_[n] = before, [start, end]
                    break
                before += w
            else:
                found[n] = hi + 1
            if n in found:
                del open_[n]
    return found


def _grow(rows: DataFrame, dims: list[str], shards: int) -> Node:
    """Split level by level at the weighted median of each node's widest dimension."""
    root = Node(0, shards, F.lit(True))
    whole = None
    level = [root] if shards > 1 else []
    while level:
        label = F.lit(None).cast("int")
        for i, node in enumerate(level):
            label = F.when(node.where, F.lit(i)).otherwise(label)
        here = rows.withColumn("node", label).where("node is not null")
        facts = here.groupBy("node").agg(F.sum("size").alias("w"), *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))])
        stats = {r["node"]: r for r in facts.collect()}
        if whole is None:
            whole = {d: max(1, stats[0][f"hi_{d}"] - stats[0][f"lo_{d}"]) if stats else 1 for d in dims}
        weight, spans, goal = {}, {}, {}
        for i, node in enumerate(level):
            s = stats.get(i)
            node.dim = dims[0] if s is None else max(dims, key=lambda d: ((s[f"hi_{d}"] - s[f"lo_{d}"]) / whole[d], -dims.index(d)))
            if s is not None:
                weight[i] = s["w"]
                spans[i] = [s[f"lo_{node.dim}"], s[f"hi_{node.dim}"]]
                goal[i] = s["w"] * (node.leaves // 2) / node.leaves
        slack = {i: w * TOLERANCE for i, w in weight.items()}
        value = _locate(here, {i: F.col(level[i].dim) for i in spans}, spans, goal, slack)
        # What equal values leave over is cut by the tie, a hash of the row.
        at = F.lit(None).cast("struct<n:int,side:int>")
        for i, v in value.items():
            own, d = F.col("node") == i, F.col(level[i].dim)
            at = F.when(own & (d <= v), F.struct(F.lit(i).alias("n"), F.when(d < v, 0).otherwise(1).alias("side"))).otherwise(at)
        sides = here.select(at.alias("at"), "size").where("at is not null").groupBy("at").agg(F.sum("size").alias("w")).collect()
        below = {(r["at"]["n"], r["at"]["side"]): r["w"] for r in sides}
        ties = {i for i in value if below.get((i, 1), 0) > slack[i] and goal[i] - below.get((i, 0), 0) > slack[i]}
        equal = here
        if ties:
            keep = F.lit(False)
            for i in ties:
                keep = keep | ((F.col("node") == i) & (F.col(level[i].dim) == value[i]))
            equal = here.where(keep)
        tie = _locate(equal, {i: F.col("tie") for i in ties}, {i: [0, TIE_SPAN - 1] for i in ties}, {i: goal[i] - below.get((i, 0), 0) for i in ties}, slack)
        following = []
        for i, node in enumerate(level):
            node.cut = (value.get(i, 0), tie.get(i, 0))
            left, test = node.leaves // 2, _below(node.dim, node.cut)
            node.kids = [Node(node.first, left, node.where & test), Node(node.first + left, node.leaves - left, node.where & ~test)]
            following += [k for k in node.kids if k.leaves > 1]
        level = following
    return root


def _leaf(node: Node) -> Column:
    if not node.kids:
        return F.lit(node.first)
    return F.when(_below(node.dim, node.cut), _leaf(node.kids[0])).otherwise(_leaf(node.kids[1]))


def assign_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 8, target_bytes: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: shards hold near-equal bytes. A node is split until
    its bytes are the target, which is ``target_bytes`` or else the total
    divided by ``shards``. The metadata dimensions are the text's bytes,
    characters and lines, and at last its checksum: all depend on the text
    alone, so equal texts lie at one point (their language or source may
    differ) and stay together unless a cut has to go through them; it then
    divides them by a hash of the row. Slots number each shard's rows from 0.

    A null or empty text has size 1, a long one is measured whole. Repeated
    rows are placed one by one. Other columns are not read, whatever their
    names. An empty table gives an empty result.
    """
    if target_bytes is not None:
        shards = shards_for(docs, target_bytes, text)
    body = F.coalesce(F.col(text), F.lit(""))
    facts = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.length(body).cast("long").alias("chars"),
        (F.length(body) - F.length(F.translate(body, "\n", ""))).cast("long").alias("lines"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("uid"),
    )
    rows = stage(facts.withColumn("tie", F.pmod(F.xxhash64("uid", "text_crc32"), F.lit(TIE_SPAN))))
    tree = _grow(rows, ["size", "chars", "lines", "text_crc32"], shards)
    placed = rows.withColumn("shard", _leaf(tree).cast("int")).drop("chars", "lines", "tie")
    placed = gapless_rank(placed, ["shard"], "uid", rows.count(), "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shards_for(docs: DataFrame, target_bytes: int, text: str = "text") -> int:
    """How many leaves bring each to the target bytes or less, about."""
    total = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1)).first()[0] or 0
    return max(1, -(-total // target_bytes))
