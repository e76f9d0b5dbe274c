"""Size-aware heavy-light Jaccard join on word shingles, and its components.

Small sets meet through their fixed-size subsets, large ones through inverted
lists of prefix shingles, rare ones first. The place of a shingle in a set's
prefix bounds the size of the partners that it may stand for, so an entry of a
list only meets entries whose sizes and places allow a link.

Inside a list no pairs are enumerated while one comparison can settle many:
first every list compares its members with its centre, the member with the
fewest rarer shingles. What that links is one component. Then only members of
different components that may still link are compared. No link that could
join two components is missed, whatever the length of a list.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .components import contracted_components
from .exact_dedup import in_filter, maybe_repeated, repeat_filter
from .shingles import mix, shingle_sets
from .support import join_groups, stage, trim

#: The largest boundary that is considered: subsets of larger sets number thousands.
MAX_SUBSETS = 24
#: Characters of text that a worker turns into shingles at once.
SLICE = 1_000_000
#: Shingles that one range of the counting step holds, about, and the bits of
#: a shingle's print in it: four cells to a shingle, so few share one. A
#: shared cell only makes rare shingles count as more frequent, in every task alike.
RANGE_SHINGLES = 1_000_000
PRINT_BITS = 22
#: Cells of the table of frequent shingles that all tasks hold, two to a byte:
#: 16 MB. Shingles in fewer sets than LEAST_FREQUENT need no order, as their
#: lists are short. Of the others as many levels of frequency as leave the
#: table an eighth full enter it, the highest first.
SLOTS = 1 << 25
LEAST_FREQUENT = 4
#: Members of a list that one part of its last step holds, about.
PART = 256


@dataclass(frozen=True)
class Threshold:
    """Two sets link when ``percent * union <= 100 * intersection``."""

    percent: int = 85

    def overlap(self, n: int) -> int:
        """The least overlap of a set of n with any set that it links to as the larger one."""
        return -(-self.percent * n // 100)

    def prefix(self, n: int) -> int:
        return n - self.overlap(n) + 1

    def subset_sizes(self, n: int, boundary: int) -> list[int]:
        """Sizes of the subsets that a small set shows: one per size of a small partner."""
        return sorted({self.overlap(m) for m in range(n, boundary + 1) if self.overlap(m) <= n})

    def partner(self, n: Column, place: Column) -> Column:
        """The largest size of a set that a set of n can link to without its first ``place`` shingles."""
        return F.floor((n - place) * (100 + self.percent) / self.percent) - n


def subsets(n: int, sizes: list[int]) -> int:
    return sum(math.comb(n, c) for c in sizes)


def choose_boundary(sets: dict[int, int], scanned: dict[int, int], t: Threshold) -> int:
    """The boundary of the least cost: subsets that small sets show, against list entries that others scan.

    ``sets`` has the sets of each size up to MAX_SUBSETS, ``scanned`` the
    members of all lists in which they stand, as counted.
    """

    def cost(b: int) -> int:
        shown = sum(k * subsets(n, t.subset_sizes(n, b)) for n, k in sets.items() if n <= b)
        return shown + sum(m for n, m in scanned.items() if n >= t.overlap(b + 1))

    return min(range(MAX_SUBSETS + 1), key=cost)


def _pack_prints(prints: np.ndarray) -> bytes:
    """Ascending prints as gaps, low bytes first, then the others: most of those are zero."""
    gaps = np.diff(prints, prepend=0).astype("<u4")
    return gaps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack_prints(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64))


def _print(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(32)) & np.uint64((1 << PRINT_BITS) - 1)


def _count_shingles(batches: Iterator[pa.RecordBatch], width: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Per range of hashes: prints of a slice's shingles and their document counts."""
    for _, texts in slices(batches, 0, 4 * SLICE):
        sets = list(shingle_sets(texts, width))
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        del sets
        cells = (every % np.uint64(ranges)) << np.uint64(PRINT_BITS) | _print(every)
        del every
        keys, n = np.unique(cells, return_counts=True)
        cuts = np.searchsorted(keys, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(PRINT_BITS))
        low, n = (keys & np.uint64((1 << PRINT_BITS) - 1)).astype(np.int64), n.astype("<u4")
        rows = [(r, _pack_prints(low[a:b]), n[a:b].view(np.uint8).reshape(-1, 4).T.tobytes()) for r, a, b in zip(range(ranges), cuts[:-1], cuts[1:], strict=True) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), *[pa.array([x[i] for x in rows], pa.binary()) for i in (1, 2)]], ["range", "prints", "counts"])


def _slot(range_: np.ndarray, prints: np.ndarray) -> np.ndarray:
    return (mix(range_.astype(np.uint64) << np.uint64(32) | prints.astype(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _by_level(pdf: pd.DataFrame) -> pd.DataFrame:
    """One range: the places of its cells in the table, by the level (the count's logarithm)."""
    r = int(pdf["range"].iloc[0])
    total = np.zeros(1 << PRINT_BITS, np.uint32)
    for prints, counts in zip(pdf["prints"], pdf["counts"], strict=True):
        total[_unpack_prints(prints)] += np.frombuffer(counts, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    cells = np.flatnonzero(total >= LEAST_FREQUENT)
    levels = np.minimum(np.frexp(total[cells])[1] - 1, 15)
    places = _slot(np.full(len(cells), r), cells).astype("<u4")
    del total
    trim()
    return pd.DataFrame([(int(k), places[levels == k].tobytes()) for k in np.unique(levels)], columns=["level", "places"])


def _merged_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition, joined: one for a level, or more once it has four million places."""
    held: dict[int, list[bytes]] = {}
    size: dict[int, int] = {}

    def flush(k: int) -> pa.RecordBatch:
        data = b"".join(held.pop(k))
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([size.pop(k) // 4], pa.int64()), pa.array([data], pa.binary())], ["level", "n", "places"])

    for batch in batches:
        for k, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(k, []).append(places)
            size[k] = size.get(k, 0) + len(places)
            if size[k] > 16_000_000:
                yield flush(k)
    for k in list(held):
        yield flush(k)


@dataclass
class Order:
    """What all tasks need to order shingles alike: a level for each cell, of bounded size."""

    ranges: int
    table: np.ndarray

    def levels(self, s: np.ndarray) -> np.ndarray:
        at = _slot(s % np.uint64(self.ranges), _print(s))
        return self.table[at >> 1] >> ((at & 1) << 2).astype(np.uint8) & 15


def pack_levels(levels: np.ndarray) -> np.ndarray:
    return levels[::2] | levels[1::2] << 4


def _global_order(texts: DataFrame, width: int) -> Order:
    """Count every shingle of every text, by ranges of the hash, and spread the levels of the frequent ones."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(64, size // (6 * RANGE_SHINGLES))
    counted = texts.mapInArrow(lambda it: _count_shingles(it, width, ranges), "range int, prints binary, counts binary")
    levels = stage(counted.groupBy("range").applyInPandas(_by_level, "level int, places binary"))
    levels = stage(levels.mapInArrow(_merged_levels, "level int, n long, places binary"))
    table = np.zeros(SLOTS, np.uint8)
    room = SLOTS // 8
    for row in sorted(levels.groupBy("level").agg(F.sum("n").alias("n")).collect(), reverse=True):
        room -= row["n"]
        if room < 0:
            break
        for part in levels.where(F.col("level") == row["level"]).select("places").toLocalIterator():
            places = np.frombuffer(part["places"], "<u4")
            table[places] = np.maximum(table[places], row["level"])
    return Order(ranges, pack_levels(table))


def prefix(s: np.ndarray, order: Order, t: Threshold) -> np.ndarray:
    """The shingles of a set's prefix, rare ones first."""
    return s[np.lexsort((s, order.levels(s)))][: t.prefix(len(s))]


def subset_keys(s: np.ndarray, boundary: int, t: Threshold) -> np.ndarray:
    """One key for each subset that a small set shows: two small sets that link share at least one."""
    values = s.tolist()
    out = [np.array([sum(x) & 0xFFFFFFFFFFFFFFFF for x in itertools.combinations(values, c)], np.uint64) + np.uint64(c) for c in t.subset_sizes(len(s), boundary)]
    return np.unique(mix(np.concatenate(out))) if out else np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()


def _signed(batches: Iterator[pa.RecordBatch], width: int, shared, t: Threshold) -> Iterator[pa.RecordBatch]:
    order = shared.value
    for batch, texts in slices(batches, 2, SLICE):
        keys, sizes, lists, small = [], [], [], []
        for s in shingle_sets(texts, width):
            keys.append(set_key(s))
            sizes.append(len(s))
            lists.append(prefix(s, order, t).view(np.int64))
            small.append(s.view(np.int64) if len(s) <= MAX_SUBSETS else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), *[pa.array(x, pa.list_(pa.int64())) for x in (lists, small)]],
            ["doc_id", "print", "key", "n", "prefix", "small"],
        )


def _subset_entries(small: DataFrame, boundary: int, t: Threshold) -> DataFrame:
    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, n, s in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                sigs = subset_keys(np.array(s, np.int64).view(np.uint64), boundary, t)
                yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array([key] * len(sigs), pa.binary()), pa.array([n] * len(sigs), pa.int64()), pa.array([0] * len(sigs), pa.int32())], ["sig", "key", "n", "place"])

    return small.where(F.col("n") <= boundary).select("key", "n", "small").mapInArrow(show, "sig long, key binary, n long, place int")


def _entries(batches: Iterator[pa.RecordBatch], repeated) -> Iterator[pa.RecordBatch]:
    """(sig, key, n, place) for the shingles of each prefix that the filter has."""
    for batch in batches:
        keys, sizes, lists = batch.columns
        ends = lists.offsets.to_numpy().astype(np.int64)
        start = 0
        while start < batch.num_rows:  # about 500,000 shingles at once
            end = max(start + 1, int(np.searchsorted(ends, ends[start] + 500_000, "right")) - 1)
            sigs = lists.values.slice(ends[start], ends[end] - ends[start]).to_numpy()
            at = np.flatnonzero(in_filter(sigs, repeated))
            row = np.searchsorted(ends, at + ends[start], "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(sigs[at]), keys.take(pa.array(row)), sizes.take(pa.array(row)), pa.array((at + ends[start] - ends[row]).astype(np.int32))], ["sig", "key", "n", "place"])
            start = end
    trim()


def _lists(shown: DataFrame, t: Threshold) -> DataFrame:
    """The lists of two and more: (sig, key, n, place, top, m), where ``top`` is the
    largest partner that the entry may stand for and ``m`` the list's length."""
    repeated = repeat_filter(shown.select(F.explode("prefix").alias("sig")), shown.agg(F.sum(F.size("prefix"))).first()[0] or 0, probes=2)
    entries = stage(shown.select("key", "n", "prefix").mapInArrow(lambda it: _entries(it, repeated), "sig long, key binary, n long, place int"))

    # The boundary, by the true lengths of the lists that small sets stand in.
    lengths = entries.groupBy("sig").agg(F.count("*").alias("m"))
    little = shown.where(F.col("n") <= MAX_SUBSETS)
    sets = {r[0]: r[1] for r in little.groupBy("n").count().collect()}
    scanned = {n: k * t.prefix(n) for n, k in sets.items()}
    few = entries.where(F.col("n") <= MAX_SUBSETS).groupBy("sig", "n").agg(F.count("*").alias("k"))
    for r in few.join(lengths, "sig").groupBy("n").agg(F.sum(F.col("k") * F.col("m"))).collect():
        scanned[r[0]] += r[1]
    boundary = choose_boundary(sets, scanned, t)
    entries = entries.where(F.col("n") >= t.overlap(boundary + 1)).unionByName(_subset_entries(little, boundary, t))

    entries = entries.withColumn("top", t.partner(F.col("n"), F.col("place")))
    facts = entries.groupBy("sig").agg(F.count("*").alias("m"), F.min("n").alias("least"), F.max("top").alias("most"), F.min(_centre()).alias("centre"))
    lists = join_groups(entries, stage(facts.where("m > 1")), "sig", "m", entries.count())
    return stage(lists.where("least <= top and most >= n").drop("least", "most"))


def _centre() -> Column:
    """Orders a list's members: the one with the smallest share of rarer shingles comes first."""
    return F.struct((F.col("place") / F.col("n")).alias("share"), "key", "n", "top")


def _sets(batches: Iterator[pa.RecordBatch], width: int, wanted) -> Iterator[pa.RecordBatch]:
    """The sets of the texts whose hash (first column) is in the filter."""
    some = (b.filter(pa.array(in_filter(b.column(0).to_numpy(), wanted))) for b in batches if b.num_rows)
    for _, texts in slices(some, 1, SLICE):
        found = {set_key(s): s.astype("<u8").tobytes() for s in shingle_sets(texts, width)}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["key", "set"])


def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    trim()
    return pd.Series([len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def _verify(pairs: DataFrame, prints: DataFrame, base: DataFrame, width: int, t: Threshold) -> DataFrame:
    """The linked ones of distinct pairs (a, b) of keys, by their whole sets.

    Sets are made again, from the texts of just these keys. The centre of a
    large list stands in many pairs: its set is one row, and adaptive
    execution deals the pairs that meet it to several tasks.
    """
    pairs = stage(pairs)
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = prints.join(keys, "key").select("print")
    hashes = stage(wanted.select(F.xxhash64("print").alias("h")))
    # Each print enters the filter twice, so "possibly repeated" says "possibly wanted".
    filter_ = repeat_filter(hashes.unionAll(hashes), 2 * hashes.count())
    sets = base.select(F.xxhash64("print"), "text").mapInArrow(lambda it: _sets(it, width, filter_), "key binary, set binary")
    sets = stage(sets.groupBy("key").agg(F.any_value("set").alias("set")))

    both = pairs.join(sets.select(F.col("key").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("key").alias("a"), F.col("set").alias("x")), "a")
    both = both.withColumn("o", F.pandas_udf(_overlap, "long")("x", "y")).withColumn("sum", (F.octet_length("x") + F.octet_length("y")) / 8)
    return stage(both.where(F.col("o") * 100 >= (F.col("sum") - F.col("o")) * t.percent).select("a", "b"))


def _links(lists: DataFrame, prints: DataFrame, base: DataFrame, width: int, t: Threshold) -> DataFrame:
    """Links (a, b) that connect whatever any links connect."""
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    centre = F.col("centre.key").alias("a"), F.col("key").alias("b")
    stars = lists.where("key <> centre.key and n <= centre.top and centre.n <= top").select(*centre).select(*ends).distinct()
    links = _verify(stars, prints, base, width, t)
    roots = stage(contracted_components(links, "a", "b"))

    # Lists whose members are not all of one component yet.
    known = roots.select(F.col("node").alias("key"), "root")
    tagged = stage(lists.drop("centre", "m").join(known, "key", "left").withColumn("comp", F.coalesce("root", "key")).drop("root", "place"))
    facts = tagged.groupBy("sig").agg(F.count("*").alias("m"), F.min("comp").alias("first"), F.max("comp").alias("last")).where("first <> last")
    open_ = join_groups(tagged, stage(facts.select("sig", "m")), "sig", "m", tagged.count())
    open_ = stage(open_.withColumn("parts", F.ceil(F.col("m") / PART).cast("int")).drop("m"))
    one = open_.select("sig", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("key").alias("a"), F.col("n").alias("na"), F.col("top").alias("ta"), F.col("comp").alias("ca"))
    other = open_.select("sig", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.col("key").alias("b"), F.col("n").alias("nb"), F.col("top").alias("tb"), F.col("comp").alias("cb"))
    apart = one.join(other, ["sig", "part"]).where("ca < cb and na <= tb and nb <= ta").select(*ends).distinct()
    return stage(links.unionByName(_verify(apart, prints, base, width, t)))


def _classes(base: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``base`` (doc_id, print, text) signed, and its classes of equal sets: (key, size, root)."""
    t = Threshold(percent)
    shared = base.sparkSession.sparkContext.broadcast(_global_order(base.select("text"), width))
    kind = base.schema["doc_id"].dataType.simpleString()
    signed = base.mapInArrow(lambda it: _signed(it, width, shared, t), f"doc_id {kind}, print binary, key binary, n long, prefix array<long>, small array<long>")
    signed = stage(signed)

    # Equal sets are one class from here on; a class is as large as it likes.
    same = signed.where("n > 0").groupBy("key").agg(F.count("*").alias("size"), F.min("print").alias("print"), *[F.any_value(c).alias(c) for c in ("n", "prefix", "small")])
    shown = stage(same)
    lists = _lists(shown.drop("print", "size"), t)
    links = _links(lists, shown.select("key", "print"), base, width, t)
    roots = contracted_components(links, "a", "b").select(F.col("node").alias("key"), "root")
    return signed, shown.select("key", "size").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))


def _base(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(body)).alias("print"), body.alias("text"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when the Jaccard similarity of their shingle sets is
    ``percent`` hundredths or more; component_id is the smallest doc_id that
    links reach. Texts without words (and null) are linked with nothing and
    are their own component; rows repeated with one id and equal sets are
    linked. A component whose ids are all null has a null id. An empty table
    gives an empty result; other columns are not read, whatever their names.
    Long texts are taken whole.
    """
    signed, classes = _classes(_base(docs, doc_id, text), width, percent)
    some = signed.where("n > 0").select("doc_id", "key", "n")
    least = some.groupBy("key").agg(F.min("doc_id").alias("least"))
    of = classes.join(least, "key")
    ids = stage(of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "size", "component_id"))
    some = join_groups(some, ids, "key", "size", signed.count())
    none = signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(none)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component stays, with all its columns: the one with
    the smallest id, null ids last, and of several texts with that id the one
    with the smallest digest. Rows with equal id and text count as one document.
    Texts without words (and null) all stay. Ids need not be unique.

    Rows alone in their component pass through without a shuffle; of the
    others, only those that stay are reduced to one row per document.
    """
    signed, classes = _classes(_base(docs, doc_id, text), width, percent)
    some = signed.where("n > 0").select("doc_id", "print", "key")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "print")
    of = classes.join(some.groupBy("key").agg(F.min(rank).alias("first")), "key")
    kept = of.groupBy("root").agg(F.min("first").alias("kept"), F.sum("size").alias("rows"))
    groups = stage(of.join(kept.where("rows > 1"), "root").select("key", "size", "kept"))
    met = stage(join_groups(some, groups, "key", "size", signed.count()).select("doc_id", "print", F.col("kept")))
    stays = met.where(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("print") == F.col("kept.print"))).select(_identity("doc_id", "print").alias("_mg_who")).distinct()
    hashes = stage(met.select(F.xxhash64(_identity("doc_id", "print")).alias("h")).distinct())
    who = _identity(doc_id, F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    # Each identity enters the filter twice, so "possibly repeated" says "possibly met"; only those rows shuffle.
    filter_ = repeat_filter(hashes.unionAll(hashes), 2 * hashes.count())
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_mg_row"), who.alias("_mg_who")).withColumn("_mg_maybe", maybe_repeated(F.xxhash64("_mg_who"), filter_))
    alone = marked.where(~F.col("_mg_maybe")).select("_mg_row.*")
    # Of those that only seem to be met, nothing is dropped: the identities met are looked up.
    some = marked.where("_mg_maybe").drop("_mg_maybe")
    known = met.select(_identity("doc_id", "print").alias("_mg_who")).distinct().join(stays.withColumn("stays", F.lit(True)), "_mg_who", "left")
    found = some.join(known.withColumn("met", F.lit(True)), "_mg_who", "left")
    seeming = found.where("met is null").select("_mg_row.*")
    one = found.where("stays").groupBy("_mg_who").agg(F.any_value("_mg_row").alias("_mg_row"))
    return alone.unionByName(seeming).unionByName(one.select("_mg_row.*"))


def _identity(doc_id: str, digest) -> Column:
    """A document's id and text in one binary value."""
    return F.concat(F.coalesce(F.concat(F.lit("i"), F.col(doc_id).cast("string")), F.lit("n")).cast("binary"), F.lit(":").cast("binary"), F.col(digest) if isinstance(digest, str) else digest)
