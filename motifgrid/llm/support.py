"""Plan-building helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import shared_folder

#: The word separators of every contract: space and the five ASCII controls 9 to 13.
SPACE_CLASS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def staged_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, so a lost
    executor costs a reread of these files and not a recomputation."""
    spark = df.sparkSession
    path = staged_path(spark)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged = path
    return back


def release(*staged: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more, and let Spark drop
    the shuffle files behind them (its cleaner follows the driver's garbage)."""
    for df in staged:
        path = getattr(df, "_staged", None)
        if path:
            spark = df.sparkSession
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    gc.collect()
    SparkSession.active().sparkContext._jvm.System.gc()


def trim() -> None:
    """Give freed memory back to the system: Python workers stay between tasks, and what an idle one keeps is lost to its executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def bind(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add columns that are evaluated exactly once.

    They leave a generator, so the optimizer cannot fold their expressions
    into the lambdas that use them, where they would run once per element.
    """
    fields = F.struct(*[e.alias(k) for k, e in exprs.items()])
    return df.select("*", F.inline(F.array(fields)))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def bucket_count(rows: int, per_bucket: int = 50_000) -> int:
    return max(64, rows // per_bucket)


def gapless_rank(df: DataFrame, keys: list[str], uid: str, rows: int, name: str) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... without gathering a key in one task.

    Rows are dealt into hash buckets of their unique id; every (key, bucket)
    is numbered on its own and shifted by the rows of the key's earlier
    buckets.  Only one row per (key, bucket) takes part in that running sum.
    """
    b = "_mg_bucket"
    dealt = df.withColumn(b, F.pmod(F.xxhash64(F.col(uid)), F.lit(bucket_count(rows))).cast("int"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, b).agg(F.count("*").alias("_mg_n"))
    shift = counts.select(*keys, b, F.coalesce(F.sum("_mg_n").over(before), F.lit(0)).alias("_mg_shift"))
    local = F.row_number().over(Window.partitionBy(*keys, b).orderBy(uid)) - 1
    numbered = dealt.withColumn("_mg_local", local)
    joined = numbered.join(shift, [*keys, b])
    return joined.withColumn(name, (F.col("_mg_shift") + F.col("_mg_local")).cast("long")).drop(b, "_mg_local", "_mg_shift")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner-join rows to their group's row, whatever a group's size.

    ``groups`` has one row per key with the number of its rows in ``size``.
    Groups of over a thousandth of ``total`` rows are under a thousand, so
    they are broadcast and their rows stay where they are; all others are
    joined by a shuffle in which no key is large.
    """
    limit = max(64, total // 1000)
    heavy = F.broadcast(groups.where(F.col(size) > limit))
    light = groups.where(F.col(size) <= limit)
    stay = rows.join(heavy, key)
    move = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return stay.unionByName(move)
