"""The graph operators as registered queries on a graph derived from the order tables, with oracle SQL.

Two parts are neighbours if one order returned both (``l_returnflag = 'R'``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, labels
from .functions.arrays import bounded, distinct_triples, intersect, nested_chain
from .model import Graph
from .operators import array_extend, bags, closed_form, structure
from .plans.decompose import decompositions
from .plans.pattern import Pattern
from .shared import fresh_path
from .sources import edgelist

Query = Callable[[SparkSession, str], DataFrame]

# The benchmark patterns.
PATTERNS = {
    "p1_c4": "4 4 0 1 0 3 1 2 2 3",
    "p2_diamond": "4 5 0 1 0 2 0 3 1 2 2 3",
    "p3_k4": "4 6 0 1 0 2 0 3 1 2 1 3 2 3",
    "p4_house": "5 6 0 1 0 2 0 4 1 3 1 4 2 3",
    "hp5_fan4": "5 7 0 1 0 4 1 2 1 4 2 3 2 4 3 4",
    "lp5_fan5": "6 9 0 1 0 2 0 3 0 4 0 5 1 2 2 3 3 4 4 5",
    "p6_near_k5": "5 8 0 1 0 2 0 3 0 4 1 2 1 3 1 4 2 3",
    "p7_k5": "5 10 0 1 0 2 0 3 0 4 1 2 1 3 1 4 2 3 2 4 3 4",
    "hp8_ladder": "6 8 0 1 0 2 1 2 1 3 2 4 3 4 3 5 4 5",
    "six_15": "6 13 0 2 0 3 0 4 0 5 1 2 1 3 1 4 1 5 2 4 2 5 3 4 3 5 4 5",
}


def pattern(name: str) -> Pattern:
    return Pattern.parse(PATTERNS[name])


def co_purchase(spark: SparkSession, sf_dir: str) -> Graph:
    """One scan of two columns; the self-join is on the order, of at most a few lines each."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey").distinct()
    both = lines.toDF("o", "u").join(lines.toDF("o", "v"), "o").where("u < v")
    return Graph(both.select("u", "v").distinct(), keep=True)


def labelled(spark: SparkSession, sf_dir: str) -> Graph:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("v"), (F.col("p_size") % 4).cast("long").alias("label"))
    g = co_purchase(spark, sf_dir)
    return g.with_labels(part.join(g.sym.select(F.col("u").alias("v")).distinct(), "v", "left_semi"))


def _on(f: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(co_purchase(spark, sf_dir))


def _labelled(f: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(labelled(spark, sf_dir))


def _count(name: str, strategy: str = "array_extend", **more) -> Query:
    return _on(lambda g: api.count(g, pattern(name), strategy, **more))


def _edge_pairs(g: Graph) -> DataFrame:
    """Edges with the neighbour arrays of both ends."""
    return g.edges.join(g.adj.toDF("u", "nu", "du"), "u").join(g.adj.toDF("v", "nv", "dv"), "v")


def _two_leaf_products(g: Graph) -> DataFrame:
    """Per triangle (a < b < c): triples of different members of the three common-neighbour sets."""
    t = closed_form.triangles(g)
    for i in range(3):
        t = t.join(g.adj.select(F.col("u").alias(f"v{i}"), F.col("nb").alias(f"n{i}")), f"v{i}")
    sets = [F.array_intersect(f"n{i}", f"n{j}") for i, j in ((0, 1), (0, 2), (1, 2))]
    return t.select("v0", "v1", "v2", distinct_triples(*sets).alias("n"))


def _chain(g: Graph) -> DataFrame:
    """Per edge: a common neighbour, then another neighbour of u: nested sets."""
    return _edge_pairs(g).select("u", "v", nested_chain([F.array_intersect("nu", "nv"), F.col("nu")]).alias("n"))


def _reduced_triangle_edges(g: Graph) -> DataFrame:
    """Edges that lie in a triangle bag: a semi-join."""
    return g.edges.join(closed_form.edge_triangles(g), ["u", "v"], "left_semi")


def _bag_count(g: Graph) -> DataFrame:
    d = decompositions(pattern("hp8_ladder"))[0]
    frames = bags.semi_reduced(g, pattern("hp8_ladder"), d)
    counts = [f.agg(F.count("*").alias("n")).withColumn("size", F.lit(len(b))) for f, b in zip(frames, d.bags, strict=True)]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("size").agg(F.sum(F.signum("n")).cast("long").alias("full_bags"))


def _stats(g: Graph) -> DataFrame:
    d = F.col("deg")
    return g.degrees.agg(F.count("*").alias("n"), (F.sum(d) / 2).cast("long").alias("m"), F.max(d).alias("max_degree"), F.sum(d * d).cast("long").alias("deg2"), F.sum(d * d * d).cast("long").alias("deg3"))


def _oriented(g: Graph) -> DataFrame:
    return g.oriented


def _three_way(g: Graph) -> DataFrame:
    t = closed_form.triangles(g)
    for i in range(3):
        t = t.join(g.adj.select(F.col("u").alias(f"v{i}"), F.col("nb").alias(f"n{i}")), f"v{i}")
    return t.select("v0", "v1", "v2", F.size(intersect([F.col(f"n{i}") for i in range(3)])).cast("long").alias("n"))


def _positions(g: Graph) -> DataFrame:
    """First neighbour over u, and how many lie over it: bounds in a sorted array."""
    over = bounded(F.col("nb"), above=[F.col("u")])
    return g.adj.select("u", F.coalesce(F.try_element_at(over, F.lit(1)), F.lit(-1)).cast("long").alias("first_over"), F.size(over).cast("long").alias("n_over"))


def _again(write: Callable, read: Callable, suffix: str = "") -> Callable[[Graph], Graph]:
    """The graph, written to the shared folder and read from there."""

    def through(g: Graph) -> Graph:
        spark = g.edges.sparkSession
        path = fresh_path(spark, suffix)
        write(g, path)
        return read(spark, path)

    return through


def _converted(spark: SparkSession, path: str) -> Graph:
    """Text, converted to binary and recognised by its first bytes."""
    target = fresh_path(spark, ".bin")
    edgelist.convert(spark, path, target)
    return edgelist.read_graph(spark, target)


def _match_file(g: Graph) -> DataFrame:
    spark, path = g.edges.sparkSession, fresh_path(g.edges.sparkSession)
    edgelist.write_matches(closed_form.triangles(g), path)
    return edgelist.read_matches(spark, path, 3)


_TEXT = _again(edgelist.write_text, edgelist.read_graph)
_BINARY = _again(edgelist.write_binary, edgelist.read_graph, ".bin")
_CONVERT = _again(edgelist.write_text, _converted)
_LABELLED = _again(edgelist.write_labelled, edgelist.read_labelled)
_PARQUET = _again(edgelist.write_parquet, edgelist.read_parquet)


QUERIES: dict[str, Query] = {
    "A1_text_scan": _on(lambda g: _TEXT(g).edges.select("u", "v")),
    "A3_binary_scan": _on(lambda g: _BINARY(g).edges.select("u", "v")),
    "A5_text_to_binary": _on(lambda g: _CONVERT(g).edges.select("u", "v")),
    "A8_labelled_text": _labelled(lambda g: _LABELLED(g).vertices.select("v", "label")),
    "A10_labelled_parquet": _labelled(lambda g: _PARQUET(g).vertices.select("v", "label")),
    "A15_match_file": _on(_match_file),
    "A12_adjacency_degree": _on(lambda g: g.adj.select("u", "deg", F.array_min("nb").alias("least"), F.array_max("nb").alias("most"))),
    "A13_edges_both": _on(lambda g: g.edge_relation(0)),
    "A13_edges_up": _on(lambda g: g.edge_relation(1)),
    "A13_edges_down": _on(lambda g: g.edge_relation(2)),
    "B1_edge_exists": _on(lambda g: closed_form.codegrees(g).join(g.edges, ["u", "v"], "left_semi").select("u", "v")),
    "B7_degree_filter": _on(lambda g: g.adj.where("deg >= 10").select("u", "deg")),
    "B11_sorted_bounds": _on(_positions),
    "D11_degree_histogram": _on(lambda g: g.degrees.groupBy("deg").agg(F.count("*").alias("n"))),
    "D11_max_degree": _on(lambda g: g.degrees.agg(F.max("deg").alias("max_degree"))),
    "C1_common_neighbours": _on(lambda g: _edge_pairs(g).select("u", "v", F.size(F.array_intersect("nu", "nv")).cast("long").alias("n"))),
    "C2_three_way_intersection": _on(_three_way),
    "C17_semijoin_reduce": _on(_reduced_triangle_edges),
    "triangle_count": _on(closed_form.triangle),
    "triangle_count__array": _on(lambda g: api.count(g, closed_form.FORMULAS["triangle"][0], "array_extend")),
    "triangle_count__sql": _on(lambda g: api.count(g, closed_form.FORMULAS["triangle"][0], "sql_join")),
    "triangle_list": _on(closed_form.triangles),
    "triangle_per_vertex": _on(lambda g: structure.per_vertex(closed_form.triangles(g))),
    "triangle_per_edge": _on(closed_form.edge_triangles),
    "wedge_count": _on(closed_form.wedge),
    "D4_star3_count": _on(closed_form.star3),
    "D4_star3_count__twins": _on(lambda g: api.count(g, closed_form.FORMULAS["star3"][0], iep=True)),
    "path4_count": _on(closed_form.path4),
    "F12_tailed_triangle_count": _on(closed_form.tailed_triangle),
    "F12_tailed_triangle_count__bags": _on(lambda g: api.count(g, closed_form.FORMULAS["tailed_triangle"][0], "bags")),
    "p1_c4": _on(closed_form.square),
    "p1_c4__array": _count("p1_c4"),
    "p1_c4__sql": _count("p1_c4", "sql_join"),
    "p1_c4__decomp": _count("p1_c4", "bags"),
    "p1_c4__twins": _count("p1_c4", iep=True),
    "p1_c4__kernel": _count("p1_c4", "kernel"),
    "p2_diamond": _on(closed_form.diamond),
    "p2_diamond__array": _count("p2_diamond"),
    "p2_diamond__twins": _count("p2_diamond", iep=True),
    "p3_k4": _on(closed_form.four_clique),
    "p3_k4__array": _count("p3_k4"),
    "p4_house": _on(closed_form.house),
    "p4_house__array": _count("p4_house"),
    "p4_house__decomp": _count("p4_house", "bags"),
    "hp5_fan4": _on(closed_form.fan4),
    "hp5_fan4__decomp": _count("hp5_fan4", "bags"),
    "lp5_fan5": _on(closed_form.fan5),
    "lp5_fan5__decomp": _count("lp5_fan5", "bags"),
    "p6_near_k5": _on(closed_form.near_five_clique),
    "p6_near_k5__array": _count("p6_near_k5"),
    "p7_k5": _count("p7_k5"),
    "hp8_ladder": _count("hp8_ladder", "bags"),
    "hp8_ladder__array": _count("hp8_ladder"),
    "six_15": _count("six_15"),
    "auto_house": _count("p4_house", "auto"),
    "D5_subset_chain": _on(_chain),
    "D6_inclusion_exclusion": _on(_two_leaf_products),
    "D9_max_two_hop": _on(lambda g: structure.two_hop_sizes(g).agg(F.max("n").alias("max_two_hop"))),
    "D10_codegree": _on(closed_form.codegrees),
    "D12_kclique_3": _on(lambda g: structure.cliques(g, 3).agg(F.count("*").alias("n_matches"))),
    "D12_kclique_4": _on(lambda g: structure.cliques(g, 4).agg(F.count("*").alias("n_matches"))),
    "D12_kclique_5": _on(lambda g: structure.cliques(g, 5).agg(F.count("*").alias("n_matches"))),
    "D12_k4_per_vertex": _on(lambda g: structure.per_vertex(structure.cliques(g, 4))),
    "D13_clique_labels": _labelled(lambda g: structure.clique_labels(g, 3)),
    "D14_core_numbers": _on(structure.core_numbers),
    "D14_core_rank": _on(structure.degeneracy_rank),
    "D15_enumerate_triangle": _on(lambda g: api.enumerate_matches(g, closed_form.FORMULAS["triangle"][0], "sql_join")),
    "D15_enumerate_diamond": _on(lambda g: array_extend.matches(g, pattern("p2_diamond"), rules=[(0, 2), (1, 3)])),
    "D15_enumerate_k4": _on(closed_form.four_cliques),
    "D16_diamond_orbits": _on(lambda g: api.local_counts(g, pattern("p2_diamond"))),
    "F25_directed_orientation": _on(_oriented),
    "F9_full_bags": _on(_bag_count),
    "graph_stats": _on(_stats),
    "B8_nlc": _labelled(labels.neighbour_labels),
    "B9_label_edges": _labelled(lambda g: g.edges.join(g.vertices.toDF("u", "lu"), "u").join(g.vertices.toDF("v", "lv"), "v").where("lu = lv").select("u", "v")),
    "C20_candidates": _labelled(lambda g: labels.candidates(g, Pattern.of([(0, 1), (0, 2), (1, 2)], labels=(0, 1, 2)))),
    "C21_refined_candidates": _labelled(lambda g: labels.refined_candidates(g, Pattern.of([(0, 1), (0, 2), (1, 2)], labels=(0, 1, 2)), 1)),
    "L_triangle": _labelled(lambda g: labels.labelled_matches(g, Pattern.of([(0, 1), (0, 2), (1, 2)], labels=(0, 1, 2)))),
    "L_triangle_equal": _labelled(lambda g: api.count(g, Pattern.of([(0, 1), (0, 2), (1, 2)], labels=(1, 1, 1)))),
}

GRAPH = """
l as (select distinct l_orderkey o, l_partkey p from lineitem where l_returnflag = 'R'),
e as materialized (select distinct a.p u, b.p v from l a join l b on a.o = b.o and a.p < b.p),
s as materialized (select u, v from e union all select v, u from e),
deg as materialized (select u, count(*) d from s group by 1),
tri as materialized (select x.u a, x.v b, y.v c from e x join e y on y.u = x.v join e z on z.u = x.u and z.v = y.v),
et as materialized (select u, v, count(*) t from (select a u, b v from tri union all select a, c from tri union all select b, c from tri) group by 1, 2),
k4 as materialized (select t.a, t.b, t.c, x.v d from tri t join e x on x.u = t.c join e y on y.u = t.a and y.v = x.v join e z on z.u = t.b and z.v = x.v),
cod as materialized (select x.v u, y.v v, count(*) c from s x join s y on x.u = y.u and x.v < y.v group by 1, 2),
lab as (select p_partkey v, cast(p_size % 4 as bigint) l from part where p_partkey in (select u from s))
"""

_FAN = """
nb as materialized (select a h, b x, c y from tri union all select b, a, c from tri union all select c, a, b from tri),
nbs as materialized (select h, x, y from nb union all select h, y, x from nb)
"""


def _sql(body: str, extra: str = "") -> str:
    return f"with {GRAPH}{', ' + extra if extra else ''} {body}"


def _one(expr: str, source: str, extra: str = "") -> str:
    return _sql(f"select cast(coalesce({expr}, 0) as bigint) n_matches from {source}", extra)


#: Core numbers: each vertex takes the h-index of its neighbours' values, over and over, far beyond where they settle.
_CORES = """
core(i, v, c) as (select 0, u, d from deg union all
  select i + 1, v, list_max(list_transform(range(1, len(x) + 1), lambda k: least(x[k], k))) from (
    select s.u v, max(core.i) i, list_reverse_sort(list(core.c)) x from core join s on s.v = core.v where core.i < 40 group by 1))
"""


_BODIES = {
    "A1_text_scan": _sql("select u, v from e"),
    "A3_binary_scan": _sql("select u, v from e"),
    "A5_text_to_binary": _sql("select u, v from e"),
    "A8_labelled_text": _sql("select v, l label from lab"),
    "A10_labelled_parquet": _sql("select v, l label from lab"),
    "A15_match_file": _sql("select a v0, b v1, c v2 from tri"),
    "D14_core_numbers": _sql("select v, cast(c as bigint) core from core where i = 40", _CORES).replace("with", "with recursive", 1),
    "D14_core_rank": _sql("select v, cast(c as bigint) core, row_number() over (order by c, d, v) - 1 as rank from core join deg on deg.u = v where i = 40", _CORES).replace("with", "with recursive", 1),
    "A12_adjacency_degree": _sql("select u, count(*) deg, min(v) least, max(v) most from s group by 1"),
    "A13_edges_both": _sql("select u, v from s"),
    "A13_edges_up": _sql("select u, v from e"),
    "A13_edges_down": _sql("select v u, u v from e"),
    "B1_edge_exists": _sql("select distinct e.u, e.v from e join cod on e.u = cod.u and e.v = cod.v"),
    "B7_degree_filter": _sql("select u, d deg from deg where d >= 10"),
    "B11_sorted_bounds": _sql("select u, coalesce(min(v) filter (v > u), -1) first_over, count(*) filter (v > u) n_over from s group by 1"),
    "D11_degree_histogram": _sql("select d deg, count(*) n from deg group by 1"),
    "D11_max_degree": _sql("select max(d) max_degree from deg"),
    "C1_common_neighbours": _sql("select e.u, e.v, coalesce(c, 0) n from e left join cod on e.u = cod.u and e.v = cod.v"),
    "C2_three_way_intersection": _sql("select a v0, b v1, c v2, count(x.v) n from tri left join (s x join s y on x.v = y.v join s z on z.v = x.v) on x.u = a and y.u = b and z.u = c group by 1, 2, 3"),
    "C17_semijoin_reduce": _sql("select u, v from et"),
    "triangle_count": _one("count(*)", "tri"),
    "triangle_list": _sql("select a v0, b v1, c v2 from tri"),
    "triangle_per_vertex": _sql("select v, count(*) n from (select a v from tri union all select b from tri union all select c from tri) group by 1"),
    "triangle_per_edge": _sql("select u, v, t from et"),
    "wedge_count": _one("sum(d * (d - 1) // 2)", "deg"),
    "D4_star3_count": _one("sum(d * (d - 1) * (d - 2) // 6)", "deg"),
    "path4_count": _one("count(*)", "e m join s x on x.u = m.u and x.v <> m.v join s y on y.u = m.v and y.v <> m.u and y.v <> x.v"),
    "F12_tailed_triangle_count": _one("sum(d - 2)", "(select a u from tri union all select b from tri union all select c from tri) join deg using (u)"),
    "p1_c4": _one("count(*)", "e x join e y on x.u = y.u and x.v < y.v join s p on p.u = x.v join s q on q.u = y.v and q.v = p.v where p.v > x.u"),
    "p2_diamond": _one("sum(t * (t - 1) // 2)", "et"),
    "p3_k4": _one("count(*)", "k4"),
    "p4_house": _one("count(*)", "e m join s r on r.u = m.u join s r2 on r2.u = m.v and r2.v = r.v join s p on p.u = m.u join s q on q.u = m.v join s x on x.u = p.v and x.v = q.v where p.v <> m.v and q.v <> m.u and r.v <> p.v and r.v <> q.v"),
    "hp5_fan4": _one("count(*)", "nb m join nbs a on a.h = m.h and a.x = m.x and a.y <> m.y join nbs b on b.h = m.h and b.x = m.y and b.y <> m.x and b.y <> a.y", _FAN),
    "lp5_fan5": _one("count(*)", "nbs p join nbs q on q.h = p.h and q.x = p.x and p.y < q.y join nbs a on a.h = p.h and a.x = p.y join nbs b on b.h = p.h and b.x = q.y where a.y <> p.x and b.y <> p.x and a.y <> q.y and b.y <> p.y and a.y <> b.y", _FAN),
    "p6_near_k5": _one("sum(t - 2)", "(select a u, b v from k4 union all select a, c from k4 union all select a, d from k4 union all select b, c from k4 union all select b, d from k4 union all select c, d from k4) join et using (u, v)"),
    "p7_k5": _one("count(*)", "k4 join e w on w.u = k4.a join e x on x.u = k4.b and x.v = w.v join e y on y.u = k4.c and y.v = w.v join e z on z.u = k4.d and z.v = w.v where w.v > k4.d"),
    "hp8_ladder": _one(
        "count(*) // 4",
        "k join tt t on t.a = k.c and t.b = k.d where t.r <> k.a and t.r <> k.b and t.r <> k.r",
        """tt as materialized (select a.u a, a.v b, b.v r from s a join s b on a.u = b.u join s d on d.u = a.v and d.v = b.v),
h as materialized (select t.a, t.b, t.r, x.v c from tt t join s x on x.u = t.a where x.v <> t.b and x.v <> t.r),
k as materialized (select h.*, y.v d from h join s y on y.u = h.b join s z on z.u = h.c and z.v = y.v where y.v <> h.a and y.v <> h.r)""",
    ),
    "six_15": _one(
        "sum(n * (n - 1) // 2) // 2",
        "(select x, y, f, t, count(*) n from (select i.x, i.y, i.q f, j.q t from hs i join hs j on i.x = j.x and i.y = j.y and i.p = j.p and i.q < j.q) group by 1, 2, 3, 4)",
        """hub as (select a x, b y, c p, d q from k4 union all select a, c, b, d from k4 union all select a, d, b, c from k4
  union all select b, c, a, d from k4 union all select b, d, a, c from k4 union all select c, d, a, b from k4),
hs as materialized (select * from hub union all select x, y, q, p from hub)""",
    ),
    "D5_subset_chain": _sql("select e.u, e.v, coalesce(c, 0) * (d - 1) n from e join deg on deg.u = e.u left join cod on cod.u = e.u and cod.v = e.v"),
    "D6_inclusion_exclusion": _sql(
        """select t.v0, t.v1, t.v2, cast(x.t * y.t * z.t - (x.t + y.t + z.t) * i + 2 * i as bigint) n
from three t join et x on x.u = v0 and x.v = v1 join et y on y.u = v0 and y.v = v2 join et z on z.u = v1 and z.v = v2""",
        "three as (select a v0, b v1, c v2, count(x.v) i from tri left join (s x join s y on x.v = y.v join s z on z.v = x.v) on x.u = a and y.u = b and z.u = c group by 1, 2, 3)",
    ),
    "D9_max_two_hop": _sql("select max(n) max_two_hop from (select u, count(*) n from (select u, v from cod union all select v, u from cod) group by 1)"),
    "D10_codegree": _sql("select u, v, c from cod"),
    "D12_k4_per_vertex": _sql("select v, count(*) n from (select a v from k4 union all select b from k4 union all select c from k4 union all select d from k4) group by 1"),
    "D13_clique_labels": _sql("select concat_ws('-', list_sort([x.l, y.l, z.l])[1], list_sort([x.l, y.l, z.l])[2], list_sort([x.l, y.l, z.l])[3]) labels, count(*) n from tri join lab x on x.v = a join lab y on y.v = b join lab z on z.v = c group by 1"),
    "D15_enumerate_diamond": _sql("select x.u v0, y.v v1, x.v v2, z.v v3 from e x join s y on y.u = x.u join s y2 on y2.u = x.v and y2.v = y.v join s z on z.u = x.u join s z2 on z2.u = x.v and z2.v = z.v where y.v < z.v"),
    "D15_enumerate_k4": _sql("select a v0, b v1, c v2, d v3 from k4"),
    "D16_diamond_orbits": _sql(
        """select 0 orbit, v, cast(sum(t * (t - 1) // 2) as bigint) n from (select u v, t from et union all select v, t from et) where t > 1 group by 2
union all select 1, v, cast(sum(t - 1) as bigint) from (
  select c v, t from tri join et on et.u = a and et.v = b union all select b, t from tri join et on et.u = a and et.v = c
  union all select a, t from tri join et on et.u = b and et.v = c) where t > 1 group by 2"""
    ),
    "F25_directed_orientation": _sql("select case when (x.d, e.u) < (y.d, e.v) then e.u else e.v end a, case when (x.d, e.u) < (y.d, e.v) then e.v else e.u end b from e join deg x on x.u = e.u join deg y on y.u = e.v"),
    "graph_stats": _sql("select count(*) n, cast(sum(d) // 2 as bigint) m, max(d) max_degree, cast(sum(d * d) as bigint) deg2, cast(sum(d * d * d) as bigint) deg3 from deg"),
    "B8_nlc": _sql("select s.u v, l label, count(*) n from s join lab on lab.v = s.v group by 1, 2"),
    "B9_label_edges": _sql("select e.u, e.v from e join lab x on x.v = e.u join lab y on y.v = e.v where x.l = y.l"),
    "C20_candidates": _sql(
        """select q, lab.v from lab join deg on deg.u = lab.v join q on q.l = lab.l where d >= 2
and (select count(*) from near where near.v = lab.v and near.l <> lab.l and near.l < 3) = 2""",
        "near as (select distinct s.u v, lab.l from s join lab on lab.v = s.v), q(q, l) as (values (0, 0), (1, 1), (2, 2))",
    ),
    "C21_refined_candidates": _sql(
        """select c.q, c.v from cand c join s on s.u = c.v join cand o on o.v = s.v and o.q <> c.q group by 1, 2 having count(distinct o.q) = 2""",
        """near as (select distinct s.u v, lab.l from s join lab on lab.v = s.v), q(q, l) as (values (0, 0), (1, 1), (2, 2)),
cand as (select q, lab.v from lab join deg on deg.u = lab.v join q on q.l = lab.l where d >= 2
  and (select count(*) from near where near.v = lab.v and near.l <> lab.l and near.l < 3) = 2)""",
    ),
    "L_triangle": _sql("select x.u v0, x.v v1, y.v v2 from s x join s y on y.u = x.u join s z on z.u = x.v and z.v = y.v join lab a on a.v = x.u and a.l = 0 join lab b on b.v = x.v and b.l = 1 join lab c on c.v = y.v and c.l = 2"),
    "L_triangle_equal": _one("count(*)", "tri join lab x on x.v = a join lab y on y.v = b join lab z on z.v = c where x.l = 1 and y.l = 1 and z.l = 1"),
}

_SAME = {
    "D12_kclique_3": "triangle_count",
    "D12_kclique_4": "p3_k4",
    "D12_kclique_5": "p7_k5",
    "D15_enumerate_triangle": "triangle_list",
    "auto_house": "p4_house",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Variants of a query (after ``__``) have its SQL. Bag tests are plan-shaped: no SQL."""
    out = {}
    for name in QUERIES:
        body = _BODIES.get(_SAME.get(name, name)) or _BODIES.get(name.split("__")[0])
        if body:
            out[name] = body
    return out
