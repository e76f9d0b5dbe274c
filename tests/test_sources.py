import pytest

import motifgrid as M
from motifgrid import cli
from motifgrid.operators import closed_form
from motifgrid.sources import datasource, edgelist
from motifgrid.sql import register_sql_functions

TEXT = "6 5\n0 1\n0 2\n1 2\n2 3\n3 4"


def test_text_binary_parquet(spark, tmp_path):
    (tmp_path / "g.txt").write_text(TEXT)
    g = edgelist.read_graph(spark, str(tmp_path / "g.txt"))
    want = sorted(map(tuple, g.edges.collect()))
    assert want == [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4)] and g.vertices.count() == 6
    edgelist.convert(spark, str(tmp_path / "g.txt"), str(tmp_path / "g.bin"))
    assert (tmp_path / "g.bin").read_bytes()[:7] == b"BINGRPH"
    for target in ("g.bin", "g.parquet"):
        if target.endswith("parquet"):
            edgelist.convert(spark, str(tmp_path / "g.txt"), str(tmp_path / target))
        assert sorted(map(tuple, edgelist.read_graph(spark, str(tmp_path / target)).edges.collect())) == want
    datasource.register(spark)
    rows = spark.read.format("edgelist").option("path", str(tmp_path / "g.txt")).load()
    assert sorted(map(tuple, rows.collect())) == want


def test_bad_files(spark, tmp_path):
    (tmp_path / "short.txt").write_text("3 4\n0 1\n1 2")
    (tmp_path / "high.txt").write_text("3 2\n0 1\n1 7")
    for name in ("short.txt", "high.txt"):
        with pytest.raises(ValueError):
            edgelist.read_graph(spark, str(tmp_path / name))


def test_labelled_and_match_files(spark, tmp_path):
    (tmp_path / "l.txt").write_text("t 3 3\nv 0 5 2\nv 1 6 2\nv 2 5 2\ne 0 1\ne 1 2\ne 0 2\n")
    g = edgelist.read_labelled(spark, str(tmp_path / "l.txt"))
    edgelist.write_labelled(g, str(tmp_path / "out"))
    back = edgelist.read_labelled(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.vertices.collect())) == [(0, 5), (1, 6), (2, 5)] and back.edges.count() == 3
    edgelist.write_matches(closed_form.triangles(g), str(tmp_path / "m"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert sorted(lines) == ["0 1 2 ", "1"]
    big = spark.createDataFrame([(10, 11, 12), (9, 11, 12), (2, 30, 31)], "v0 long, v1 long, v2 long")
    edgelist.write_matches(big, str(tmp_path / "big"))
    parts = sorted((tmp_path / "big").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split("\n")[:-1] == ["3", "2 30 31 ", "9 11 12 ", "10 11 12 "]
    assert sorted(map(tuple, edgelist.read_matches(spark, str(tmp_path / "big"), 3).collect())) == [(2, 30, 31), (9, 11, 12), (10, 11, 12)]
    edgelist.write_parquet(g, str(tmp_path / "p"))
    back = edgelist.read_parquet(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, back.vertices.collect())) == [(0, 5), (1, 6), (2, 5)] and back.edges.count() == 3


def test_text_folder_and_single_vertex(spark, tmp_path):
    lone = M.Graph.from_edges(spark.createDataFrame([], "u long, v long"), vertices=spark.createDataFrame([(0, 0)], "v long, label long"))
    many = M.Graph.random(spark, 200, 900, 3)
    for name, g in (("lone", lone), ("many", many)):
        edgelist.write_text(g, str(tmp_path / name))
        edgelist.write_binary(g, str(tmp_path / f"{name}.bin"))
        for back in (edgelist.read_graph(spark, str(tmp_path / name)), edgelist.read_graph(spark, str(tmp_path / f"{name}.bin"))):
            assert back.vertices.count() == g.vertices.count()
            assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, g.edges.collect()))


def test_cli_and_sql(spark, tmp_path, capsys):
    (tmp_path / "g.txt").write_text(TEXT)
    (tmp_path / "q.txt").write_text("3 3 0 1 0 2 1 2")
    assert cli.main(["-q", str(tmp_path / "q.txt"), "-d", str(tmp_path / "g.txt"), "-r", str(tmp_path / "r"), "-u"]) == 0
    assert "number of matches: 1" in capsys.readouterr().out and (tmp_path / "r").exists()
    register_sql_functions(spark)
    row = spark.sql("select * from pattern_info('4 4 0 1 1 2 2 3 0 3')").first()
    assert (row["vertices"], row["automorphisms"], row["width"]) == (4, 8, 2.0)
    spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3)], "u long, v long").createOrReplaceTempView("e")
    found = spark.sql("select * from graph_match(table(select '3 3 0 1 0 2 1 2' pattern, u, v from e) with single partition)")
    assert [r["vertices"] for r in found.collect()] == [[0, 1, 2]]
    assert M.Graph.random(spark, 20, 50, 1).edges.count() == M.Graph.random(spark, 20, 50, 1).edges.count()
