"""Labelled vertices: neighbour label counts, candidates and label-true matching."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import Graph
from .operators import sql_join
from .plans.pattern import Pattern


def neighbour_labels(g: Graph) -> DataFrame:
    """``(v, label, n)``: how many neighbours of v have each label."""
    of = g.vertices.select(F.col("v").alias("w"), "label")
    return g.sym.toDF("v", "w").join(of, "w").groupBy("v", "label").agg(F.count("*").alias("n"))


def candidates(g: Graph, p: Pattern) -> DataFrame:
    """``(q, v)``: data vertices with the label, degree and neighbour label counts of pattern vertex q."""
    nlc = neighbour_labels(g).groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("near"))
    rows = g.vertices.join(nlc, "v", "left").join(g.degrees.withColumnRenamed("u", "v"), "v", "left")
    fits = []
    for q in range(p.n):
        need = Counter(p.labels[w] for w in p.adjacent[q])
        test = (F.col("label") == p.labels[q]) & (F.coalesce("deg", F.lit(0)) >= len(p.adjacent[q]))
        for label, n in sorted(need.items()):
            test = test & (F.coalesce(F.try_element_at("near", F.lit(label).cast("long")), F.lit(0)) >= n)
        fits.append(F.when(test, F.lit(q)))
    return rows.select("v", F.explode(F.array_compact(F.array(*fits))).alias("q")).select("q", "v")


def refined_candidates(g: Graph, p: Pattern, rounds: int = 2) -> DataFrame:
    """Candidates with a neighbour among the candidates of every pattern neighbour, over a bounded number of semi-join rounds."""
    arcs = [(a, b) for a, b in p.edges] + [(b, a) for a, b in p.edges]
    links = g.edges.sparkSession.createDataFrame(arcs, "q long, r long")
    need = [(q, len(p.adjacent[q])) for q in range(p.n)]
    wanted = g.edges.sparkSession.createDataFrame(need, "q long, need long")
    now = candidates(g, p)
    for _ in range(rounds):
        steps = now.join(F.broadcast(links), "q").join(g.sym.toDF("v", "w"), "v")
        there = now.select(F.col("q").alias("r"), F.col("v").alias("w"))
        met = steps.join(there, ["r", "w"], "left_semi").select("q", "v", "r").distinct().groupBy("q", "v").agg(F.count("*").alias("n"))
        now = met.join(F.broadcast(wanted), "q").where("n = need").select(F.col("q").cast("int").alias("q"), "v")
    return now


def labelled_matches(g: Graph, p: Pattern) -> DataFrame:
    """Matches whose vertices carry the pattern's labels; symmetry follows the labels too."""
    found = sql_join.matches(g, p)
    cand = candidates(g, p)
    for q in range(p.n):
        own = cand.where(F.col("q") == q).select(F.col("v").alias(f"v{q}"))
        found = found.join(own, f"v{q}", "left_semi")
    return found.select(*[f"v{i}" for i in range(p.n)])
