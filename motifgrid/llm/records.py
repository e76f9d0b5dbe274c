"""Token ids in length-delimited binary records, with a separate offset index.

A file is a run of frames, each followed by one line feed::

    length      8 bytes   payload bytes, unsigned
    length crc  4 bytes   masked crc32 of the 8 length bytes
    payload     length    header, doc_id (8, signed), ids (2 or 4 each)
    payload crc 4 bytes   masked crc32 of the payload

All numbers are little-endian. Bit 0 of the one-byte header says that doc_id
is null, bit 1 that ids take four bytes. A masked checksum is the crc32
rotated right by 15 bits plus 0xa282ead8, so that a checksum stored among
data is never the checksum of what it lies in.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_vocabulary, encoder, slices
from .support import staged_path

#: Text bytes that go to one file: a file's ids stay below half of that.
FILE_TEXT_BYTES = 24 << 20
INDEX = "file int, ordinal long, position long, size long, doc_id long, n_tokens long, file_start long, ids_crc32 long"


def masked_crc(data) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    head = struct.pack("<Bq", (doc_id is None) | wide << 1, doc_id or 0)
    payload = head + ids.astype("<u4" if wide else "<u2").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def parse(data, position: int) -> tuple[int | None, np.ndarray, int]:
    """The record at a position: doc_id, ids and where the next record starts."""
    length = bytes(data[position : position + 8])
    (size,) = struct.unpack("<Q", length)
    if struct.unpack_from("<I", data, position + 8)[0] != masked_crc(length):
        raise ValueError(f"record at {position}: the length's checksum is wrong")
    start = position + 12
    payload = data[start : start + size]
    if struct.unpack_from("<I", data, start + size)[0] != masked_crc(payload):
        raise ValueError(f"record at {position}: the payload's checksum is wrong")
    flags, doc_id = struct.unpack_from("<Bq", payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9)
    return (None if flags & 1 else doc_id), ids, start + size + 5


@dataclass(frozen=True)
class RecordSet:
    """Where the record files and their index (a Parquet table) lie."""

    files: str
    index: str


def _frames(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None) -> Iterator[pa.RecordBatch]:
    coder = encoder(path, library=True)
    wide = coder.vocabulary.width > 1 << 16
    tail = np.array([] if end_id is None else [end_id], np.int32)
    for batch, texts in slices(batches, 1, 2_000_000):
        ids, bounds = coder.encode_batch(texts)
        out = [frame(d, np.concatenate([ids[a:b], tail]), wide) for d, a, b in zip(batch.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries of whole files, each record verified."""
    types = [pa.int32(), *[pa.int64()] * 7]
    names = [c.split()[0] for c in INDEX.split(", ")]
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            number = int(re.search(r"part-(\d+)", name)[1])
            data = memoryview(content.as_buffer())
            rows, position, start = [], 0, 0
            while position < len(data):
                doc_id, ids, after = parse(data, position)
                rows.append((number, len(rows), position, after - position, doc_id, len(ids), start, zlib.crc32(ids.astype("<u4").tobytes())))
                position, start = after, start + len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _contents(spark: SparkSession, records: RecordSet) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(records.files)
    return found.select("path", "content")


def write_records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 0, path: str | None = None, to: RecordSet | None = None) -> RecordSet:
    """Encode every text, write the files in ascending doc_id order and index them.

    Null texts are empty and keep their end id. Rows with one doc_id stay
    beside each other; null ids come first. Files are ranges of doc_id of
    about equal rows, many enough that one holds ``FILE_TEXT_BYTES`` of text;
    a range is cut within equal ids by the row, so no id fills a task. Spark's
    text writer commits the frames, so a lost or doubled task leaves no part
    of a file; the frame's closing line feed is the writer's line end.
    """
    spark = docs.sparkSession
    vocabulary = path or default_vocabulary()
    root = staged_path(spark)
    to = to or RecordSet(f"{root}/files", f"{root}/index")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(8, -(-size // FILE_TEXT_BYTES))
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n, "doc_id", "row")
    ordered = ranged.sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    frames = ordered.mapInArrow(lambda it: _frames(it, vocabulary, end_id), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(to.files)
    _contents(spark, to).mapInArrow(_read, INDEX).write.parquet(to.index)
    return to


def read_index(spark: SparkSession, records: RecordSet) -> DataFrame:
    """The offset index with ``start``: the ids of all documents before each.

    Only one row per file takes part in the running sum over files.
    """
    index = spark.read.schema(INDEX).parquet(records.index)
    per_file = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = per_file.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    return index.join(base, "file").withColumn("start", F.col("base") + F.col("file_start")).drop("base")


def read_records(spark: SparkSession, records: RecordSet, picked: DataFrame | None = None) -> DataFrame:
    """``(doc_id, ids)`` of the index rows in ``picked`` (default: all), by offset.

    Any subset or order of index rows will do: a shuffled read picks rows at
    random and sorts what comes back by its own key.
    """
    picked = read_index(spark, records) if picked is None else picked
    wanted = picked.groupBy("file").agg(F.collect_list("position").alias("positions"))
    files = _contents(spark, records).withColumn("file", F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, positions in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = memoryview(content.as_buffer())
                got = [parse(data, p) for p in positions]
                lists = pa.array([g[1].astype(np.int32) for g in got], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), lists], ["doc_id", "ids"])

    return files.join(wanted, "file").select("content", "positions").mapInArrow(fetch, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Write, read back and report each document: doc_id, start, n_tokens, ids_crc32."""
    records = write_records(docs, doc_id, text, 0, path)
    return read_index(docs.sparkSession, records).select("doc_id", "start", "n_tokens", "ids_crc32")
