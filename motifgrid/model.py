"""The data graph as DataFrames."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stats:
    """What the planner knows of a graph: one small aggregate."""

    vertices: int
    edges: int
    max_degree: int
    wedges: int
    degree_cubes: int

    @property
    def mean_degree(self) -> float:
        return 2 * self.edges / self.vertices if self.vertices else 0.0


class Graph:
    """A simple undirected graph: ``edges(u, v)`` with ``u < v``, distinct, no loops.

    ``vertices(v, label)`` is optional; without it the vertices are those of
    edges, all with label 0.
    """

    def __init__(self, edges: DataFrame, vertices: DataFrame | None = None, keep: bool = False):
        """``keep``: relations that several steps read (edges, adjacency,
        triangles) stay in memory and on disk; a lost part is computed again."""
        self.keep = keep
        self.edges = self.kept(edges)
        self._vertices = vertices
        self.memo: dict[str, DataFrame] = {}

    def kept(self, df: DataFrame) -> DataFrame:
        return df.persist() if self.keep else df

    @classmethod
    def from_edges(cls, edges: DataFrame, u: str = "u", v: str = "v", vertices: DataFrame | None = None) -> Graph:
        """Canonical form of any edge list: both directions, repeats and loops may occur; rows with null go."""
        a, b = F.col(u).cast("long"), F.col(v).cast("long")
        pairs = edges.where((a != b) & a.isNotNull() & b.isNotNull())
        return cls(pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), vertices)

    @classmethod
    def random(cls, spark: SparkSession, vertices: int, edges: int, seed: int = 0) -> Graph:
        """About ``edges`` uniform edges over ``vertices`` vertices, the same for a seed."""
        ends = [F.floor(F.rand(seed + i) * vertices).cast("long") for i in (0, 1)]
        drawn = spark.range(edges).select(ends[0].alias("u"), ends[1].alias("v"))
        return cls.from_edges(drawn, vertices=spark.range(vertices).select(F.col("id").alias("v"), F.lit(0).cast("long").alias("label")))

    @functools.cached_property
    def sym(self) -> DataFrame:
        """Both directions of every edge."""
        return self.edges.unionAll(self.edges.select(F.col("v").alias("u"), F.col("u").alias("v")))

    @functools.cached_property
    def adj(self) -> DataFrame:
        """``(u, nb ascending, deg)``."""
        lists = self.sym.groupBy("u").agg(F.array_sort(F.collect_list("v")).alias("nb"))
        return self.kept(lists.withColumn("deg", F.size("nb").cast("long")))

    @functools.cached_property
    def degrees(self) -> DataFrame:
        """``(u, deg)`` without gathering neighbours."""
        return self.sym.groupBy("u").agg(F.count("*").alias("deg"))

    @functools.cached_property
    def vertices(self) -> DataFrame:
        if self._vertices is not None:
            return self._vertices
        return self.sym.select(F.col("u").alias("v")).distinct().withColumn("label", F.lit(0).cast("long"))

    @functools.cached_property
    def oriented(self) -> DataFrame:
        """``(a, b)``: every edge from its end of lower (degree, id) to the other.

        No vertex has more than sqrt(2m) edges out, so joins over this
        direction stay small at hubs.
        """
        e = self.edges.join(self.degrees.select("u", F.col("deg").alias("du")), "u")
        e = e.join(self.degrees.select(F.col("u").alias("v"), F.col("deg").alias("dv")), "v")
        first = F.struct("du", "u") < F.struct("dv", "v")
        return e.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("b"))

    def edge_relation(self, kind: int) -> DataFrame:
        """Type 0: both directions; 1: ``v > u``; 2: ``v < u``."""
        return {0: self.sym, 1: self.edges, 2: self.edges.select(F.col("v").alias("u"), F.col("u").alias("v"))}[kind]

    def with_labels(self, vertices: DataFrame) -> Graph:
        return Graph(self.edges, vertices, self.keep)

    def unlabelled(self) -> Graph:
        """The graph with every label 0."""
        return Graph(self.edges, self.vertices.select("v", F.lit(0).cast("long").alias("label")))

    def cache(self) -> Graph:
        """The same graph, kept for several patterns."""
        return Graph(self.edges, self._vertices, keep=True)

    @functools.cached_property
    def stats(self) -> Stats:
        d = F.col("deg")
        row = self.degrees.agg(F.count("*"), F.sum(d), F.max(d), F.sum(d * (d - 1)), F.sum(d.cast("decimal(38,0)") * d * d)).first()
        return Stats(row[0], (row[1] or 0) // 2, row[2] or 0, int(row[3] or 0) // 2, int(row[4] or 0))
