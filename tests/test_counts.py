import itertools
import random

import pytest
from pyspark.sql import functions as F

import motifgrid as M
from motifgrid.operators import array_extend, closed_form, kernel, structure
from motifgrid.queries import PATTERNS, pattern
from motifgrid.streaming.edges import TriangleFeed

SMALL = {
    "edge": [(0, 1)],
    "k4": list(itertools.combinations(range(4), 2)),
    "k5": list(itertools.combinations(range(5), 2)),
    "c4": [(0, 1), (1, 2), (2, 3), (0, 3)],
    "star": [(0, i) for i in range(1, 6)],
}
EXPECTED = {"edge": (0, 0, 0, 0), "k4": (4, 3, 6, 1), "k5": (10, 15, 30, 5), "c4": (0, 1, 0, 0), "star": (0, 0, 0, 0)}


def brute(edges, p):
    near = set(edges) | {(b, a) for a, b in edges}
    ids = sorted({v for e in edges for v in e})
    n = sum(all((x[a], x[b]) in near for a, b in p.edges) for x in itertools.permutations(ids, p.n))
    return n // len(p.automorphisms)


def graph(spark, edges):
    return M.Graph.from_edges(spark.createDataFrame(edges or [(0, 0)], "u long, v long"))


def one(df):
    return df.first()[0]


@pytest.mark.parametrize("name", SMALL)
def test_tiny_graphs(spark, name):
    g = graph(spark, SMALL[name])
    got = [one(f(g)) for f in (closed_form.triangle, closed_form.square, closed_form.diamond, closed_form.four_clique)]
    assert tuple(got) == EXPECTED[name]


def test_every_strategy_against_brute_force(spark):
    rnd = random.Random(3)
    edges = [e for e in itertools.combinations(range(9), 2) if rnd.random() < 0.55]
    g = graph(spark, edges + [(b, a) for a, b in edges[:5]] + edges[:3] + [(1, 1)])
    for name in PATTERNS:
        p = pattern(name)
        want = brute(edges, p)
        strategies = ["array_extend", "bags", "kernel"] + (["sql_join"] if p.n < 6 else []) + (["closed_form"] if closed_form.formula_for(p) else [])
        assert {s: one(M.count(g, p, s)) for s in strategies} == dict.fromkeys(strategies, want), name
        assert one(M.count(g, p, iep=True)) == want


def test_kernel_beyond_its_budget(spark):
    """Blocks of first vertices, also where one vertex's lists are split into pieces (a share of 20 entries)."""
    rnd = random.Random(4)
    edges = [(a, b) for a, b in itertools.combinations(range(-3, 6), 2) if rnd.random() < 0.5]
    g = graph(spark, edges).cache()
    for name, share in (("p1_c4", 20), ("p1_c4", 500), ("p4_house", 500), ("six_15", 500)):
        p = pattern(name)
        blocks = kernel._first_blocks(g, p, kernel._order(p), 32 * share).select("block.pieces").collect()
        assert (max(r[0] for r in blocks) > 1) == (share == 20)
        assert one(kernel._blocks(g, p, kernel._order(p), set(p.rules(first=kernel._order(p))), 32 * share)) == brute(edges, p), name
    assert one(kernel.count(g, pattern("p2_diamond"), 32 * 20)) == brute(edges, pattern("p2_diamond"))


def test_empty_graph_loops_and_disconnected(spark):
    g = graph(spark, [])
    assert one(closed_form.triangle(g)) == 0 and one(M.count(g, pattern("p1_c4"), "array_extend")) == 0
    assert g.stats.edges == 0
    with pytest.raises(ValueError):
        M.Pattern.of([(0, 1), (2, 3)])


def test_hub_needs_more_than_32_bits(spark):
    n = 70_000
    g = M.Graph(spark.range(1, n + 1).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")))
    assert one(closed_form.wedge(g)) == n * (n - 1) // 2
    assert one(M.count(g, closed_form.FORMULAS["star3"][0], iep=True)) == n * (n - 1) * (n - 2) // 6


def test_cores_orbits_and_cliques(spark):
    g = graph(spark, SMALL["k4"] + [(3, 4), (4, 5)])
    assert {tuple(r) for r in structure.core_numbers(g).collect()} == {(0, 3), (1, 3), (2, 3), (3, 3), (4, 1), (5, 1)}
    assert sorted(r["rank"] for r in structure.degeneracy_rank(g).collect()) == list(range(6))
    assert {tuple(r) for r in M.local_counts(g, pattern("p3_k4")).collect()} == {(0, v, 1) for v in range(4)}
    assert one(structure.cliques(g, 3).agg(F.count("*"))) == 4


def test_labels(spark):
    g = graph(spark, SMALL["k4"]).with_labels(spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 2)], "v long, label long"))
    p = M.Pattern.of([(0, 1), (0, 2), (1, 2)], labels=(1, 1, 2))
    assert one(M.count(g, p)) == 2


def test_stream_feed(spark, tmp_path):
    feed = TriangleFeed(str(tmp_path / "e"))
    for i, part in enumerate(([(0, 1), (1, 2)], [(0, 2), (1, 3)], [(2, 3), (0, 1), (0, 3)])):
        feed(spark.createDataFrame(part, "u long, v long"), i)
    feed = TriangleFeed(str(tmp_path / "e"))  # a restart: what is known lies in the folders
    feed(spark.createDataFrame([(2, 3), (0, 1), (0, 3)], "u long, v long"), 2)
    assert feed.total(spark) == 4
    feed(spark.createDataFrame([(4, 2), (4, 3), (4, 4)], "u long, v long"), 3)
    assert feed.total(spark) == 5 and TriangleFeed(str(tmp_path / "none")).total(spark) == 0


def test_plan_text(spark):
    text = M.explain(graph(spark, SMALL["k5"]), pattern("hp8_ladder"))
    assert "strategy:" in text and "rules:" in text


def test_intersections_are_reused(spark):
    """Of a clique's arrays only the last one is carried beside the intersection so far."""
    p = M.Pattern.of([(a, b) for a in range(5) for b in range(a)])
    uses = array_extend._reuse(p, [0, 1, 2, 3, 4])
    assert [uses[v][1:] for v in (2, 3, 4)] == [(frozenset(), {0, 1}), ({0, 1}, {2}), ({0, 1, 2}, {3})]
    g = M.Graph.random(spark, 25, 200, 5)
    df = array_extend._extend(g, p, [0, 1, 2, 3, 4], 4, set())
    assert sorted(c for c in df.columns if c[0] != "v") == ["i0_1_2", "n3"]
    assert one(array_extend.count(g, p)) == one(M.count(g, p, "sql_join"))
