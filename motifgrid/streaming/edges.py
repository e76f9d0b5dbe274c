"""Edge streams: a distinct edge set that grows batch by batch, and triangle counts kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..operators.closed_form import triangles


class TriangleFeed:
    """A ``foreachBatch`` sink. Edges live in one Parquet folder per batch
    under ``path``, so a batch that is run again replaces its own folder; the
    triangles a batch adds are those with at least one new edge. What is known
    is what the folders hold, also after a restart."""

    def __init__(self, path: str):
        self.path = path

    def _batches(self, spark, kind: str) -> list[int]:
        """The batches whose folder of that kind is whole."""
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(fs_path(f"{self.path}/{kind}=*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = Graph.from_edges(batch).edges
        # A batch that runs again sees only those before it, as it did at first.
        kept = [f"{self.path}/batch={i}" for i in self._batches(spark, "batch") if i < batch_id]
        known = spark.read.parquet(*kept) if kept else None
        if known is not None:
            new = new.join(known, ["u", "v"], "left_anti")
        new.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        new = spark.read.parquet(f"{self.path}/batch={batch_id}")
        whole = Graph(new if known is None else known.unionByName(new))
        new_triangles(whole, new).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.path}/added={batch_id}")

    def total(self, spark) -> int:
        """Triangles so far."""
        parts = [f"{self.path}/added={i}" for i in self._batches(spark, "added")]
        return spark.read.parquet(*parts).agg(F.sum("n")).first()[0] if parts else 0


def new_triangles(g: Graph, new: DataFrame) -> DataFrame:
    """Triangles of the graph with an edge among the new ones, each once."""
    ends = new.select(F.col("u").alias("x"), F.col("v").alias("y"))
    near = g.sym.groupBy("u").agg(F.collect_list("v").alias("nb"))
    wide = ends.join(near.toDF("x", "a"), "x").join(near.toDF("y", "b"), "y")
    third = wide.select("x", "y", F.explode(F.array_intersect("a", "b")).alias("z"))
    three = F.array_sort(F.array("x", "y", "z"))
    return third.select(*[three[i].alias(f"v{i}") for i in range(3)]).distinct()


__all__ = ["TriangleFeed", "new_triangles", "triangles"]
