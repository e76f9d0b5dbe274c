"""``python -m motifgrid.cli -q PATTERN -d GRAPH [-r RESULT] [-i] [-u] [-t N]`` and ``convert IN OUT``."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from . import api
from .operators import closed_form
from .plans.pattern import Pattern, load_directory
from .sources import edgelist


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    if args[:1] == ["convert"]:
        edgelist.convert(SparkSession.builder.getOrCreate(), args[1], args[2])
        return 0
    ask = argparse.ArgumentParser(prog="motifgrid")
    ask.add_argument("-q", help="pattern file, or a folder of them")
    ask.add_argument("-k", choices=sorted(closed_form.FORMULAS), help="a pattern with its own formula instead of a file")
    ask.add_argument("-d", required=True, help="data graph: text, binary or .parquet")
    ask.add_argument("-r", help="result file")
    ask.add_argument("-i", action="store_true", help="extend by intersecting neighbour arrays")
    ask.add_argument("-u", action="store_true", help="count twin vertices by a binomial")
    ask.add_argument("-t", type=int, default=1, help="local threads, where no session runs")
    got = ask.parse_args(args)
    spark = SparkSession.getActiveSession() or SparkSession.builder.master(f"local[{got.t}]").getOrCreate()
    g = edgelist.read_graph(spark, got.d)
    if got.k:
        patterns = {got.k: closed_form.FORMULAS[got.k][0]}
    else:
        patterns = load_directory(got.q) if Path(got.q).is_dir() else {Path(got.q).name: Pattern.load(got.q)}
    if len(patterns) > 1:
        g = g.cache()
    lines = []
    for name, p in patterns.items():
        began = time.time()
        text = api.explain(g, p, "array_extend" if got.i else "auto")
        planned = time.time()
        n = api.count(g, p, "array_extend" if got.i else "auto", iep=got.u).first()[0]
        lines += [name, text, f"planning time (s): {planned - began:.3f}", f"number of matches: {n}", f"execution time (s): {time.time() - planned:.3f}"]
    print("\n".join(lines))
    if got.r:
        Path(got.r).write_text("\n".join(lines) + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
