"""Byte-level BPE encoding and decoding with a pair occurrence index."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokenize import split_words
from .support import trim

#: Distinct words whose ids a worker keeps, the first ones; after four times as many others it starts anew.
CACHE_WORDS = 300_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Merges, ids and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        letters = _byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        top = max([*ids.values(), *self.specials.values()])
        self.bytes_of: list[bytes] = [b""] * (top + 1)
        for token, i in ids.items():
            self.bytes_of[i] = token.encode() if token in self.specials else bytes(back[c] for c in token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.decimal = [str(i).encode() for i in range(top + 1)]
        self.byte_ids = np.array([ids[c] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = top + 1
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = self.left * self.width + self.right
        self.rank_order = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is no such merge."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank_order[at], -1)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, concatenated, and how many each has.

        The words lie end to end as linked symbols. An index maps each
        mergeable pair, by rank, to all its places; active ranks are taken in
        ascending order from a heap, all places of a rank merge at once, and
        the pairs that this creates enter the lists of their ranks.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        symbol = np.append(self.byte_ids[raw], -1)
        following = np.arange(1, n + 2)
        before = np.arange(-1, n)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        following[ends - 1] = n
        before = np.append(before, -1)[: n + 1]
        before[starts] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(places: np.ndarray) -> None:
            ranks = self.ranks(symbol[places], symbol[following[places]])
            ok = ranks >= 0
            places, ranks = places[ok], ranks[ok]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, group in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts), strict=True):
                if r in index:
                    index[r].append(group)
                else:
                    index[r] = [group]
                    heapq.heappush(active, r)

        enter(np.arange(n))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            places = lists[0] if len(lists) == 1 else np.sort(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            places = places[(symbol[places] == a) & (symbol[following[places]] == b)]
            if not len(places):
                continue
            if a == b and len(places) > 1:  # in a run of one symbol every other place merges
                chained = np.zeros(len(places), bool)
                chained[1:] = following[places[:-1]] == places[1:]
                k = np.arange(len(places))
                first = np.maximum.accumulate(np.where(chained, 0, k))
                places = places[(k - first) % 2 == 0]
            gone = following[places]
            after = following[gone]
            symbol[places] = self.made[r]
            symbol[gone] = -2
            following[places] = after
            before[after] = places
            left = before[places]
            touched = np.concatenate([left[left >= 0], places[after < n]])
            if len(touched):
                touched.sort()
                once = np.ones(len(touched), bool)
                once[1:] = touched[1:] != touched[:-1]
                enter(touched[once])
        alive = symbol[:n] >= 0
        total = np.concatenate([[0], np.cumsum(alive)])
        return symbol[:n][alive], total[ends] - total[starts]


class Encoder:
    """Encodes batches of texts; each distinct word is merged once and then looked up.

    ``library``: the tokenizers library's model merges the new words, in
    place of the pair index.
    """

    def __init__(self, path: str, library: bool = False):
        self.vocabulary = Vocabulary(path)
        self.library = None
        if library:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path).model
            self.letters = dict(enumerate(_byte_letters()))
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.others = 0
        self.flat = np.zeros(0, np.int32)
        self.offset = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.library is None:
            return self.vocabulary.merge_words(words)
        ids: list[int] = []
        sizes = []
        for w in words:
            got = self.library.tokenize(w.decode("latin-1").translate(self.letters))
            ids += [t.id for t in got]
            sizes.append(len(got))
        return np.array(ids, np.int64), np.array(sizes, np.int64)

    def _slots(self, words: list[list[bytes]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """For each list of words their slots; then all ids, and where those of
        a slot begin and how many they are. New words are encoded, all at once."""
        if self.others > 4 * CACHE_WORDS:
            self.clear()
        get = self.known.get
        slots = [[get(w, -1) for w in part] for part in words]
        fresh = list(dict.fromkeys(w for part, at in zip(words, slots, strict=True) for w, k in zip(part, at, strict=True) if k < 0))
        flat, offset, size = self.flat, self.offset, self.size
        if fresh:
            ids, sizes = self._encode_words(fresh)
            new = dict(zip(fresh, range(len(size), len(size) + len(fresh)), strict=True))
            slots = [[new[w] if k < 0 else k for w, k in zip(part, at, strict=True)] for part, at in zip(words, slots, strict=True)]
            offset = np.concatenate([offset, len(flat) + np.cumsum(sizes) - sizes])
            flat = np.concatenate([flat, ids.astype(np.int32)])
            size = np.concatenate([size, sizes])
            if len(self.known) < CACHE_WORDS:
                self.known.update(new)
                self.flat, self.offset, self.size = flat, offset, size
            else:
                self.others += len(fresh)
        return [np.array(at, np.int64) for at in slots], flat, offset, size

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, bounds)``: text i has ``ids[bounds[i]:bounds[i + 1]]``."""
        pieces, owner, glue = [], [], {}
        for i, t in enumerate(texts):
            cut = [(t, None)]
            for s, sid in self.vocabulary.specials.items():
                if s in t:
                    cut = [x for part, end in cut for x in _cut(part, s, sid, end)]
            for part, end in cut:
                if end is not None:
                    glue[len(pieces)] = end
                pieces.append(part)
                owner.append(i)
        chunks = list(split_words(pieces))
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        out, counts = [], np.zeros(len(pieces), np.int64)
        slots, flat, offset, sizes = self._slots([w.distinct for w, _ in chunks])
        for slot_of, (w, texts_of) in zip(slots, chunks, strict=True):
            slot = slot_of[w.index]
            size = sizes[slot]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            take = np.repeat(offset[slot] - (ends - size), size) + np.arange(total)
            out.append(flat[take])
            before = np.concatenate([[0], ends])
            words = np.concatenate([[0], np.cumsum(w.per_text)])
            np.add.at(counts, texts_of, np.diff(before[words]))
        ids = np.concatenate(out)
        ends = np.cumsum(counts)
        if glue:
            at = sorted(glue)
            ids = np.insert(ids, ends[at], [glue[k] for k in at])
            counts[at] += 1
        per_text = np.zeros(len(texts), np.int64)
        np.add.at(per_text, np.array(owner, np.int64), counts)
        return ids, np.concatenate([[0], np.cumsum(per_text)])

    def decode(self, ids) -> str:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _cut(text: str, special: str, sid: int, end):
    parts = text.split(special)
    return [(p, sid) for p in parts[:-1]] + [(parts[-1], end)]


@functools.lru_cache(2)
def encoder(path: str, library: bool = False) -> Encoder:
    """One encoder per Python worker: the vocabulary and the words seen stay between tasks."""
    return Encoder(path, library)


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches whose texts have about ``limit`` bytes, with those texts (null: empty)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
            part = batch.slice(start, end - start)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            start = end
    trim()


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, 1):
        ids, bounds = encoder(path).encode_batch(texts)
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every text, as the tokenizers library gives them.

    A null text is empty; an empty text has no ids. Special tokens' strings
    in a text become their ids. Rows repeat as they come.
    """
    path = path or default_vocabulary()
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(lambda it: _encode(it, path), f"doc_id {kind}, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [encoder(path).decode(ids or []) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``(doc_id, text)``: special tokens are kept; null ids give an empty text."""
    path = path or default_vocabulary()
    kind = encoded.schema[doc_id].dataType.simpleString()
    return encoded.select(F.col(doc_id), F.col(ids)).mapInArrow(lambda it: _decode(it, path), f"doc_id {kind}, text string")


def _round_trip(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = encoder(path)
    names, raw = coder.vocabulary.decimal, coder.vocabulary.bytes_of
    for batch, texts in slices(batches, 1):
        ids, bounds = coder.encode_batch(texts)
        n, of_ids, of_text = [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = ids[a:b].tolist()
            back = b"".join(map(raw.__getitem__, own)).decode("utf-8", "replace")
            n.append(b - a)
            of_ids.append(hashlib.sha256(b",".join(map(names.__getitem__, own))).hexdigest())
            of_text.append(hashlib.sha256(back.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or default_vocabulary()
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(lambda it: _round_trip(it, path), schema)
