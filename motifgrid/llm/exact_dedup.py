"""Exact dedup with two passes over a counting Bloom filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import join_groups, stage, trim

PROBES = 4
SEGMENT = 1 << 16
#: Counters per row, and the bound on all counters: the filter that is sent
#: around has one bit for each, 16 MB at most. Beyond the bound more rows
#: count as possibly repeated and shuffle; the result is the same.
COUNTERS_PER_ROW = 16
MAX_COUNTERS = 1 << 27


def _probes(hashes: np.ndarray, counters: int, probes: int = PROBES) -> np.ndarray:
    """The places of each 64-bit hash; all differ, as the step is odd."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    k = np.arange(probes, dtype=np.uint64)
    return (h[:, None] + k * step[:, None]) & np.uint64(counters - 1)


def _tally(batches: Iterator[pa.RecordBatch], counters: int, probes: int = PROBES) -> Iterator[pa.RecordBatch]:
    """Places touched once and more than once, by segment of the filter."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        places, n = np.unique(np.concatenate(held), return_counts=True)
        segments, starts = np.unique(places // SEGMENT, return_index=True)
        low = (places % SEGMENT).astype("<u2")
        rows = []
        for s, a, b in zip(segments, starts, [*starts[1:], len(places)], strict=True):
            part, many = low[a:b], n[a:b] > 1
            rows.append((int(s), part.tobytes(), part[many].tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["segment", "touched", "again"])

    held, size = [], 0
    for batch in batches:
        places = _probes(batch.column(0).to_numpy(zero_copy_only=False), counters, probes).ravel()
        held.append(places)
        size += len(places)
        if size > 2_000_000:
            yield from flush(held)
            held, size = [], 0
    if size:
        yield from flush(held)
    del held
    trim()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bit per counter: set where at least two rows touched it."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, touched, again in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            c = counts.setdefault(s, np.zeros(SEGMENT, np.uint8))
            places = np.frombuffer(touched, "<u2")
            c[places] = np.minimum(c[places] + 1, 2)
            c[np.frombuffer(again, "<u2")] = 2
    for s, c in counts.items():
        bits = np.packbits(c == 2).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([bits], pa.binary())], ["segment", "bits"])


def repeat_filter(hashes: DataFrame, rows: int, max_counters: int = MAX_COUNTERS, probes: int = PROBES):
    """First pass: a broadcast bitmap with no false negatives for repeated hashes.

    Map tasks tally their own places, merging tasks each hold some segments
    of the filter, and only the merged bits (bounded by ``max_counters``)
    pass through the driver.
    """
    counters = SEGMENT
    while counters < min(rows * COUNTERS_PER_ROW, max_counters):
        counters *= 2
    tallied = hashes.mapInArrow(lambda it: _tally(it, counters, probes), "segment int, touched binary, again binary")
    merged = tallied.repartition("segment").mapInArrow(_merge, "segment int, bits binary")
    bits = np.zeros(counters // 8, np.uint8)
    for row in merged.toLocalIterator():
        at = row["segment"] * (SEGMENT // 8)
        bits[at : at + SEGMENT // 8] = np.frombuffer(row["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast((counters, bits, probes))


def in_filter(hashes: np.ndarray, shared) -> np.ndarray:
    """Which of the hashes the filter has, in a worker."""
    counters, bits, probes = shared.value
    places = _probes(hashes, counters, probes)
    got = bits[places >> np.uint64(3)] >> (np.uint64(7) - (places & np.uint64(7))).astype(np.uint8)
    return (got & 1).all(axis=1)


def maybe_repeated(hash_column: Column, shared) -> Column:
    """Second pass: false only for hashes that occur once."""

    @F.pandas_udf("boolean")
    def probe(h: pd.Series) -> pd.Series:
        return pd.Series(in_filter(h.to_numpy(np.int64), shared))

    return probe(hash_column)


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of each group the
    row with the largest doc_id stays (null ids come first); of repeated rows
    with that id exactly one does. An empty table gives an empty result.

    The text is read once: digests are staged, and of them only those whose
    hash is possibly repeated are shuffled.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    digests = stage(docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.xxhash64(body).alias("h"), F.unhex(F.sha2(body, 256)).alias("sha")))
    n = digests.count()
    shared = repeat_filter(digests.select("h"), n)
    flagged = stage(digests.select("doc_id", "uid", "sha", maybe_repeated(F.col("h"), shared).alias("maybe")))
    some = flagged.where("maybe").drop("maybe")
    groups = stage(some.groupBy("sha").agg(F.max(F.struct("doc_id", "uid")).alias("keep"), F.count("*").alias("group_size")))
    found = join_groups(some, groups, "sha", "group_size", n)
    found = found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("keep.uid")).alias("kept"), "sha")
    alone = flagged.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return alone.unionByName(found).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Rows whose hash occurs once pass through without a shuffle. The others
    are reduced to one row per text, on the map side first.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    hashes = stage(docs.select(F.xxhash64(body).alias("h")))
    shared = repeat_filter(hashes, hashes.count())
    cols = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_mg_row")
    held = docs.select(row, F.col(doc_id).alias("_mg_id"), F.sha2(body, 256).alias("_mg_sha"), maybe_repeated(F.xxhash64(body), shared).alias("_mg_maybe"))
    alone = held.where(~F.col("_mg_maybe")).select("_mg_row.*")
    order = F.struct(F.col("_mg_id").isNotNull(), F.col("_mg_id"))
    reduced = held.where("_mg_maybe").groupBy("_mg_sha").agg(F.max_by("_mg_row", order).alias("_mg_row"))
    return alone.unionByName(reduced.select("_mg_row.*"))
