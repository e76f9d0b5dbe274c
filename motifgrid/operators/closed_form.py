"""Counts by formula over triangles, wedges and common neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import choose
from ..model import Graph
from ..plans.pattern import Pattern


def _total(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0)).cast("long").alias("n_matches")


def triangles(g: Graph) -> DataFrame:
    """``(v0 < v1 < v2)``, each once; neighbours out along the degree order are intersected."""
    if "triangles" in g.memo:
        return g.memo["triangles"]
    out = g.oriented.groupBy("a").agg(F.collect_list("b").alias("out"))
    pairs = g.oriented.join(out, "a").join(out.toDF("b", "out2"), "b")
    found = pairs.select("a", "b", F.explode(F.array_intersect("out", "out2")).alias("c"))
    three = F.array_sort(F.array("a", "b", "c"))
    g.memo["triangles"] = g.kept(found.select(*[three[i].alias(f"v{i}") for i in range(3)]))
    return g.memo["triangles"]


def edge_triangles(g: Graph) -> DataFrame:
    """``(u < v, t)``: triangles of each edge that has any."""
    sides = F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in (("v0", "v1"), ("v0", "v2"), ("v1", "v2"))]))
    return triangles(g).select(sides.alias("e")).select("e.*").groupBy("u", "v").agg(F.count("*").alias("t"))


def _with_sides(g: Graph) -> DataFrame:
    """Triangles with the triangle counts t01, t02, t12 of their edges."""
    t = edge_triangles(g)
    out = triangles(g)
    for a, b in ((0, 1), (0, 2), (1, 2)):
        out = out.join(t.toDF(f"v{a}", f"v{b}", f"t{a}{b}"), [f"v{a}", f"v{b}"])
    return out


def four_cliques(g: Graph) -> DataFrame:
    """``v0 < v1 < v2 < v3``."""
    t = triangles(g)
    last = t.groupBy("v0", "v1").agg(F.collect_list("v2").alias("x"))
    wide = t.join(last, ["v0", "v1"]).join(last.toDF("v0", "v2", "y"), ["v0", "v2"]).join(last.toDF("v1", "v2", "z"), ["v1", "v2"])
    third = F.array_intersect(F.array_intersect("x", "y"), F.col("z"))
    return wide.select("v0", "v1", "v2", F.explode(third).alias("v3"))


def codegrees(g: Graph) -> DataFrame:
    """``(u < v, c)``: common neighbours of every pair that has any."""
    left, right = g.sym.toDF("m", "u"), g.sym.toDF("m", "v")
    return left.join(right, "m").where("u < v").groupBy("u", "v").agg(F.count("*").alias("c"))


def wedge(g: Graph) -> DataFrame:
    return g.degrees.agg(_total(choose(F.col("deg"), 2)))


def star3(g: Graph) -> DataFrame:
    return g.degrees.agg(_total(choose(F.col("deg"), 3)))


def triangle(g: Graph) -> DataFrame:
    return triangles(g).agg(F.count("*").alias("n_matches"))


def path4(g: Graph) -> DataFrame:
    """Middle edges times their free ends; the ends meet once per triangle and middle edge."""
    d = g.degrees
    e = g.edges.join(d.toDF("u", "du"), "u").join(d.toDF("v", "dv"), "v")
    open_ = e.agg(F.coalesce(F.sum((F.col("du") - 1) * (F.col("dv") - 1)), F.lit(0)).alias("a"))
    closed = triangles(g).agg(F.count("*").alias("b"))
    return open_.crossJoin(closed).select((F.col("a") - F.col("b") * 3).cast("long").alias("n_matches"))


def tailed_triangle(g: Graph) -> DataFrame:
    corners = triangles(g).select(F.explode(F.array("v0", "v1", "v2")).alias("u"))
    return corners.join(g.degrees, "u").agg(_total(F.col("deg") - 2))


def square(g: Graph) -> DataFrame:
    """Far corners: wedges x-m-y with x least; any two of a pair's middles close a square."""
    wedges = g.edges.toDF("x", "m").join(g.sym.toDF("m", "y"), "m").where("x < y")
    return wedges.groupBy("x", "y").agg(F.count("*").alias("c")).agg(_total(choose(F.col("c"), 2)))


def diamond(g: Graph) -> DataFrame:
    return edge_triangles(g).agg(_total(choose(F.col("t"), 2)))


def house(g: Graph) -> DataFrame:
    """Per edge, triangles times squares on it, less the roofs that are a corner of the square.

    Over all edges those overlaps are 2 t^2 - 2 t: a triangle gives each
    of its sides the wedges of the other two.
    """
    t = edge_triangles(g)
    both = t.unionAll(t.select(F.col("v").alias("u"), F.col("u").alias("v"), "t")).toDF("x", "y", "t")
    c = codegrees(g)
    # Squares on edge x-y, by the corner q opposite x: one for each common neighbour of x and q but y.
    steps = both.where("x < y").join(g.sym.toDF("y", "q"), "y").where("q <> x")
    pairs = steps.select(F.least("x", "q").alias("u"), F.greatest("x", "q").alias("v"), "t")
    paths = pairs.join(c, ["u", "v"]).agg(F.coalesce(F.sum(F.col("t") * (F.col("c") - 1)), F.lit(0)).alias("a"))
    over = t.agg(F.coalesce(F.sum(F.col("t") * (F.col("t") - 1) * 2), F.lit(0)).alias("b"))
    return paths.crossJoin(over).select((F.col("a") - F.col("b")).cast("long").alias("n_matches"))


def fan4(g: Graph) -> DataFrame:
    """Per triangle and hub, the free ends on both sides; ends that coincide are four-cliques."""
    x, y, z = (F.col(c) - 1 for c in ("t01", "t02", "t12"))
    open_ = _with_sides(g).agg(F.coalesce(F.sum(x * y + x * z + y * z), F.lit(0)).alias("a"))
    closed = four_cliques(g).agg(F.count("*").alias("b"))
    return open_.crossJoin(closed).select((F.col("a") - F.col("b") * 12).cast("long").alias("n_matches"))


def fan5(g: Graph) -> DataFrame:
    """Paths of five in each hub's neighbourhood, by their two inner vertices b and d.

    With w common neighbours c of b and d there, the outer ends are free but
    for c, the other inner vertex and each other.
    """
    t = triangles(g)
    hub = F.explode(F.array(*[F.struct(F.col(h).alias("h"), F.col(a).alias("a"), F.col(b).alias("b")) for h, a, b in (("v0", "v1", "v2"), ("v1", "v0", "v2"), ("v2", "v0", "v1"))]))
    near = t.select(hub.alias("e")).select("e.*")
    both = near.unionAll(near.select("h", F.col("b").alias("a"), F.col("a").alias("b")))
    deg = both.groupBy("h", "a").agg(F.count("*").alias("d"))
    pairs = both.toDF("h", "c", "b").join(both.toDF("h", "c", "d"), ["h", "c"]).where("b < d").groupBy("h", "b", "d").agg(F.count("*").alias("w"))
    pairs = pairs.join(deg.toDF("h", "b", "db"), ["h", "b"]).join(deg.toDF("h", "d", "dd"), ["h", "d"])
    pairs = pairs.join(near.select("h", F.least("a", "b").alias("b"), F.greatest("a", "b").alias("d"), F.lit(1).alias("tie")), ["h", "b", "d"], "left")
    tie = F.coalesce("tie", F.lit(0))
    ends = (F.col("db") - 1 - tie) * (F.col("dd") - 1 - tie) - (F.col("w") - 1)
    return pairs.agg(_total(F.col("w") * ends))


def near_five_clique(g: Graph) -> DataFrame:
    """A four-clique and one more vertex on one of its edges."""
    t = edge_triangles(g)
    sides = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    each = F.explode(F.array(*[F.struct(F.col(f"v{a}").alias("u"), F.col(f"v{b}").alias("v")) for a, b in sides]))
    return four_cliques(g).select(each.alias("e")).select("e.*").join(t, ["u", "v"]).agg(_total(F.col("t") - 2))


def four_clique(g: Graph) -> DataFrame:
    return four_cliques(g).agg(F.count("*").alias("n_matches"))


#: Name -> (pattern, formula).
FORMULAS: dict[str, tuple[Pattern, Callable[[Graph], DataFrame]]] = {
    "wedge": (Pattern.of([(0, 1), (0, 2)]), wedge),
    "triangle": (Pattern.of([(0, 1), (0, 2), (1, 2)]), triangle),
    "star3": (Pattern.of([(0, 1), (0, 2), (0, 3)]), star3),
    "path4": (Pattern.of([(0, 1), (1, 2), (2, 3)]), path4),
    "tailed_triangle": (Pattern.of([(0, 1), (0, 2), (1, 2), (0, 3)]), tailed_triangle),
    "square": (Pattern.of([(0, 1), (1, 2), (2, 3), (0, 3)]), square),
    "diamond": (Pattern.of([(0, 1), (0, 2), (0, 3), (1, 2), (2, 3)]), diamond),
    "four_clique": (Pattern.of([(a, b) for a in range(4) for b in range(a)]), four_clique),
    "house": (Pattern.of([(0, 1), (0, 2), (0, 4), (1, 3), (1, 4), (2, 3)]), house),
    "fan4": (Pattern.of([(0, 1), (0, 4), (1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]), fan4),
    "fan5": (Pattern.of([(0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (1, 2), (2, 3), (3, 4), (4, 5)]), fan5),
    "near_five_clique": (Pattern.of([(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (1, 3), (1, 4), (2, 3)]), near_five_clique),
}


def formula_for(p: Pattern) -> str | None:
    if p.labels:
        return None
    return next((n for n, (q, _) in FORMULAS.items() if (q.n, len(q.edges)) == (p.n, len(p.edges)) and q.canonical == p.canonical), None)
