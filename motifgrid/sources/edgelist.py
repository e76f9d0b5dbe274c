"""Graph files: edge-list text, compact binary, labelled text, match lists."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph

MAGIC = b"BINGRPH"
HEADER = len(MAGIC) + 8


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t"))


def _with_isolated(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("v"), F.lit(0).cast("long").alias("label"))


def read_text(spark: SparkSession, path: str) -> Graph:
    """Header ``n m``, then m lines ``u v``. The header is the first line, of
    the first file where the path is a folder; a file with fewer edges than it says, or ids beyond n, is refused."""
    files = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    n, m = (int(x) for x in files.where(F.col("file") == files.agg(F.min("file")).first()[0]).first()["value"].split()[:2])
    rows = _lines(spark, path).where(F.size("t") >= 2).select(F.col("t")[0].cast("long").alias("u"), F.col("t")[1].cast("long").alias("v"))
    # The header's pair is one row too many; loops and repeats fall with the canonical form.
    seen = rows.agg(F.count("*"), F.count_if((F.col("u") == n) & (F.col("v") == m)), F.max(F.greatest("u", "v"))).first()
    if seen[0] - 1 < m:
        raise ValueError(f"{path}: {seen[0] - 1} edges, the header says {m}")
    edges = rows.where(~((F.col("u") == n) & (F.col("v") == m)))
    if edges.where((F.col("u") >= n) | (F.col("v") >= n)).limit(1).count():
        raise ValueError(f"{path}: a vertex id is not below {n}")
    return Graph.from_edges(edges, vertices=_with_isolated(spark, n))


def _binary_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            data = memoryview(content.as_buffer())
            n, m = struct.unpack_from("<II", data, len(MAGIC))
            if bytes(data[: len(MAGIC)]) != MAGIC or len(data) != HEADER + 8 * m:
                raise ValueError("not a binary graph, or its size does not fit its header")
            pairs = np.frombuffer(data, "<u4", offset=HEADER).reshape(-1, 2).astype(np.int64)
            if len(pairs) and pairs.max() >= n:
                raise ValueError(f"a vertex id is not below {n}")
            for at in range(0, max(1, len(pairs)), 1 << 16):
                part = pairs[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["u", "v"])


def read_binary(spark: SparkSession, path: str) -> Graph:
    """Magic, u32 n, u32 m, then m pairs of u32; Parquet is the format for graphs beyond one file's 2 GB."""
    files = spark.read.format("binaryFile").load(path).select("content")
    head = files.select(F.substring("content", 1, HEADER).alias("h")).first()["h"]
    n = struct.unpack_from("<I", head, len(MAGIC))[0]
    return Graph.from_edges(files.mapInArrow(_binary_edges, "u long, v long"), vertices=_with_isolated(spark, n))


def is_binary(spark: SparkSession, path: str) -> bool:
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, len(MAGIC)).alias("h")).first()
    return head is not None and bytes(head["h"]) == MAGIC


def read_graph(spark: SparkSession, path: str) -> Graph:
    """Binary or text, by the file's first bytes; a folder of Parquet holds ``u, v``."""
    if path.rstrip("/").endswith(".parquet"):
        return Graph.from_edges(spark.read.parquet(path))
    return read_binary(spark, path) if is_binary(spark, path) else read_text(spark, path)


def _size(g: Graph) -> tuple[int, int]:
    """Vertices, counted to the highest id, and edges."""
    top = g.vertices.agg(F.max("v")).first()[0]
    return (0 if top is None else top + 1), g.edges.count()


def write_text(g: Graph, path: str) -> None:
    """A folder whose part files, in order, are the text format: header first, edges ascending."""
    spark = g.edges.sparkSession
    n, m = _size(g)
    head = spark.createDataFrame([(-1, -1, f"{n} {m}")], "u long, v long, value string")
    rows = g.edges.select("u", "v", F.concat_ws(" ", "u", "v").alias("value"))
    head.unionAll(rows).repartitionByRange("u", "v").sortWithinPartitions("u", "v").select("value").write.text(path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each batch as the format's bytes."""
    for batch in batches:
        pairs = np.stack([batch.column(i).to_numpy() for i in range(2)], axis=1).astype("<u4")
        yield pa.RecordBatch.from_arrays([pa.array([pairs.tobytes()], pa.binary())], ["block"])


def write_binary(g: Graph, path: str) -> None:
    """One file, wherever Hadoop can write: executors make its blocks, which pass through the driver one by one."""
    n, m = _size(g)
    if n >= 1 << 32 or m >= 1 << 32:
        raise ValueError("the binary format holds 32-bit ids and counts")
    spark = g.edges.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(MAGIC + struct.pack("<II", n, m)))
        for row in g.edges.orderBy("u", "v").mapInArrow(_blocks, "block binary").toLocalIterator(prefetchPartitions=True):
            out.write(bytearray(row["block"]))
    finally:
        out.close()


def write_parquet(g: Graph, path: str) -> None:
    """A folder with ``edges`` and ``vertices`` (with their labels): the format for graphs of any size."""
    g.edges.write.parquet(f"{path}/edges")
    g.vertices.select("v", "label").write.parquet(f"{path}/vertices")


def read_parquet(spark: SparkSession, path: str) -> Graph:
    return Graph.from_edges(spark.read.parquet(f"{path}/edges"), vertices=spark.read.parquet(f"{path}/vertices"))


def convert(spark: SparkSession, source: str, target: str) -> None:
    """Text to binary, or to Parquet if the target ends so."""
    g = read_graph(spark, source)
    if target.endswith(".parquet"):
        g.edges.write.parquet(target)
    else:
        write_binary(g, target)


def read_labelled(spark: SparkSession, path: str) -> Graph:
    """Lines ``t n m``, ``v id label degree`` and ``e u v``."""
    t = _lines(spark, path)
    at = lambda i: F.col("t")[i].cast("long")
    vertices = t.where("t[0] = 'v'").select(at(1).alias("v"), at(2).alias("label"))
    return Graph.from_edges(t.where("t[0] = 'e'").select(at(1).alias("u"), at(2).alias("v")), vertices=vertices)


def write_labelled(g: Graph, path: str) -> None:
    spark = g.edges.sparkSession
    n, m = g.vertices.count(), g.edges.count()
    head = spark.createDataFrame([(0, -1, -1, f"t {n} {m}")], "k int, a long, b long, value string")
    deg = g.vertices.join(g.degrees.toDF("v", "deg"), "v", "left")
    v = deg.select(F.lit(1).alias("k"), F.col("v").alias("a"), F.lit(0).cast("long").alias("b"), F.concat_ws(" ", F.lit("v"), "v", "label", F.coalesce("deg", F.lit(0))).alias("value"))
    e = g.edges.select(F.lit(2).alias("k"), F.col("u").alias("a"), F.col("v").alias("b"), F.concat_ws(" ", F.lit("e"), "u", "v").alias("value"))
    head.unionAll(v).unionAll(e).repartitionByRange("k", "a", "b").sortWithinPartitions("k", "a", "b").select("value").write.text(path)


def write_matches(matches: DataFrame, path: str) -> None:
    """``count`` first, then one match a line, in vertex order of the pattern, ascending."""
    cols = matches.columns
    head = matches.sparkSession.range(1).select(F.lit(0).alias("k"), *[F.lit(-1).cast("long").alias(c) for c in cols], F.lit(str(matches.count())).alias("value"))
    rows = matches.select(F.lit(1).alias("k"), *cols, F.concat(F.concat_ws(" ", *cols), F.lit(" ")).alias("value"))
    head.unionAll(rows).repartitionByRange("k", *cols).sortWithinPartitions("k", *cols).select("value").write.text(path)


def read_matches(spark: SparkSession, path: str, vertices: int) -> DataFrame:
    """``v0..``: the matches of a file or folder written so; the line of the count has one field."""
    t = _lines(spark, path).where(F.size("t") == vertices)
    return t.select(*[F.col("t")[i].cast("long").alias(f"v{i}") for i in range(vertices)])
