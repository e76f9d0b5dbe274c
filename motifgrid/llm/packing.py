"""Packing documents into sequences by cutting-stock column generation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import colgen
from .bpe import default_vocabulary, encoder, slices
from .support import gapless_rank, stage

LENGTH = 2048
#: Lengths are rounded up to classes of this many tokens for the linear program.
CLASS_WIDTH = 8
END_ID = 1

TOKENIZED = "uid long, doc_id {kind}, doc_tokens long, full_crcs array<long>, rest long, rest_crc long, head_crc long, tail_crc long"


def _head(rest: int, width: int) -> int:
    """Where a rest may be cut: the largest power of two below its class's end, 0 if there is none.

    It depends on the class alone, so all of a class cut alike.
    """
    top = -(-rest // width) * width
    cut = 1 << ((top - 1).bit_length() - 1)
    return cut if width <= cut < rest and top & (top - 1) else 0


def _tokenize(batches: Iterator[pa.RecordBatch], path: str, length: int, width: int) -> Iterator[pa.RecordBatch]:
    coder = encoder(path, library=True)
    end = np.array([END_ID], "<u4")
    for batch, texts in slices(batches, 2, 2_000_000):
        ids, bounds = coder.encode_batch(texts)
        rows = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            data = np.concatenate([ids[a:b].astype("<u4"), end]).tobytes()
            n = len(data) // 4
            crc = lambda i, j, d=data: zlib.crc32(memoryview(d)[4 * i : 4 * j])
            full = n // length
            start, rest = full * length, n % length
            head = _head(rest, width) if rest else 0
            rows.append((n, [crc(k * length, (k + 1) * length) for k in range(full)], rest, crc(start, n), crc(start, start + head), crc(start + head, n)))
        cols = [pa.array([r[i] for r in rows], pa.list_(pa.int64()) if i == 1 else pa.int64()) for i in range(6)]
        names = ["uid", "doc_id", "doc_tokens", "full_crcs", "rest", "rest_crc", "head_crc", "tail_crc"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names)


def plan_table(plan: colgen.Plan) -> tuple[list[tuple], int]:
    """Rows (class, low, high, pieces per sequence, first sequence, place) by rank, and the sequences used.

    Pieces of a class are ranked 0, 1, ...; those from ``low`` up to ``high``
    fill one pattern's slots in all its sequences.
    """
    rows, base, used = [], 0, {}
    for pattern, times in plan.patterns:
        for place, (c, a) in enumerate(sorted(pattern.items(), reverse=True)):
            low = used.get(c, 0)
            used[c] = low + a * times
            rows.append((c, low, used[c], a, base, place))
        base += times
    return rows, base


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, width: int = CLASS_WIDTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids end with the end id, so null and empty texts have one
    token. Whole lengths of a document are sequences of their own. The rests
    are counted by length class; a linear program over patterns of classes,
    its columns priced by a knapsack, says how many sequences take each
    pattern. Where whole rests would leave much room, some are cut in two at a
    power of two. Documents are ranked within their class, and rank ranges
    map to sequences, so no document list reaches the driver: it sees a
    histogram of at most ``length`` rows and broadcasts a plan of that order.

    Rows repeat as they come; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    vocabulary = path or default_vocabulary()
    kind = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    tokens = stage(base.mapInArrow(lambda it: _tokenize(it, vocabulary, length, width), TOKENIZED.format(kind=kind)))
    rests = tokens.where("rest > 0").withColumn("class", F.ceil(F.col("rest") / width).cast("long"))

    seen = {r["class"]: r["count"] for r in rests.groupBy("class").count().collect()}
    halves = {}
    for c in seen:
        if head := _head(c * width, width):
            halves[c] = (head // width, c - head // width)
    plan = colgen.solve(seen, length // width, halves)
    rows, sequences = plan_table(plan)
    total = sum(seen.values())

    # Pieces: the first ranks of a class are cut where the plan says so.
    ranked = gapless_rank(rests, ["class"], "uid", total, "rank")
    cuts = spark.createDataFrame([(c, n, halves[c][0] * width) for c, n in plan.splits.items()], "class long, cuts long, head long")
    ranked = ranked.join(F.broadcast(cuts), "class", "left")
    first = F.col("doc_tokens") - F.col("rest")
    whole = F.array(F.struct(first.alias("start"), F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32")))
    both = F.array(
        F.struct(first.alias("start"), F.col("head").alias("length"), F.col("head_crc").alias("ids_crc32")),
        F.struct((first + F.col("head")).alias("start"), (F.col("rest") - F.col("head")).alias("length"), F.col("tail_crc").alias("ids_crc32")),
    )
    parts = F.when(F.col("rank") < F.coalesce("cuts", F.lit(0)), both).otherwise(whole)
    pieces = ranked.select("uid", "doc_id", "doc_tokens", F.posexplode(parts).alias("part", "p")).select((F.col("uid") * 2 + F.col("part")).alias("uid"), "doc_id", "doc_tokens", "p.*")
    pieces = stage(pieces.withColumn("class", F.ceil(F.col("length") / width).cast("long")))
    pieces = gapless_rank(pieces, ["class"], "uid", total, "rank")

    table = spark.createDataFrame(rows, "class long, low long, high long, a long, base long, place long")
    slots = table.groupBy("class").agg(F.collect_list(F.struct("low", "high", "a", "base", "place")).alias("slots"))
    placed = pieces.join(F.broadcast(slots), "class")
    hit = F.get(F.filter("slots", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"])), F.lit(0))
    placed = placed.withColumn("slot", hit).withColumn("sequence_id", F.expr("slot.base + (rank - slot.low) div slot.a"))
    inside = Window.partitionBy("sequence_id").orderBy("slot.place", "rank")
    offset = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    packed = placed.withColumn("offset", F.coalesce(offset, F.lit(0)).cast("long")).select(*cols, "offset")

    full = tokens.where("doc_tokens >= %d" % length).select("uid", "doc_id", "doc_tokens", F.posexplode("full_crcs").alias("k", "ids_crc32"))
    full = full.withColumn("one", F.lit(1)).withColumn("piece", F.concat_ws(":", "uid", "k"))
    full = gapless_rank(full, ["one"], "piece", total, "rank")
    alone = full.select("doc_id", (F.col("k") * length).cast("long").alias("start"), F.lit(length).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("rank") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def sequences(docs: DataFrame, pieces: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``(sequence_id, ids)``: the packed token sequences, without padding.

    ``doc_id`` must be unique. Sequences are bounded, so each is gathered whole.
    """
    from .bpe import encode

    ids = encode(docs, doc_id, text, path).withColumn("ids", F.concat("ids", F.array(F.lit(END_ID))))
    cut = pieces.join(ids, "doc_id").select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
    grouped = cut.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
