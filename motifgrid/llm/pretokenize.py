"""Byte-level BPE words of a batch of texts, found with array operations.

The words are those of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Runs of letters, digits, blanks and the rest follow from the classes of
neighbouring characters, so no pattern matcher visits the text.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from tokenizers.pre_tokenizers import ByteLevel

OTHER, LETTER, NUMBER, BLANK = range(4)
# The code points with Unicode's White_Space property.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Characters handled at once; bounds the memory of a batch.
CHUNK = 1_000_000


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point.

    Letters and digits follow the Unicode version of the tokenizers library:
    where two other versions at hand disagree, the library is asked.
    """
    every = "".join(map(chr, range(0x110000)))
    newer = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for run in regex.finditer(pattern, every):
            newer[run.start() : run.end()] = kind
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(c)[0], OTHER) for c in every], np.uint8)
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in np.flatnonzero(table != newer).tolist():
        found = split(f"a{chr(c)}1")
        table[c] = LETTER if found[0][1] == (0, 2) else NUMBER if len(found) == 2 else OTHER
    table[WHITE_SPACE] = BLANK
    return table


@dataclass
class Words:
    """Words of one chunk: its distinct ones, each place's index among them, and how many each text has."""

    distinct: list[bytes]
    index: np.ndarray
    per_text: np.ndarray


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flags of the places where a word starts; ``first`` marks where a text starts."""
    n = len(points)
    kind = classes()[points]
    new_run = np.ones(n, bool)
    new_run[1:] = kind[1:] != kind[:-1]
    new_run |= first
    blank = kind == BLANK
    last = np.ones(n, bool)  # of its run
    last[:-1] = new_run[1:]
    more = np.zeros(n, bool)  # the text goes on after this place
    more[:-1] = ~first[1:]
    starts = new_run.copy()
    starts |= blank & last & more
    joined = np.zeros(n, bool)
    joined[1:] = (points[:-1] == 0x20) & more[:-1]
    starts &= blank | ~joined
    for q in np.flatnonzero((points == 0x27) & new_run & ~joined):
        tail = points[q + 1 : q + 3]
        ahead = more[q : q + 2]
        if len(tail) and ahead[0]:
            size = 1 if chr(tail[0]) in "stmd" else 2 if len(tail) == 2 and ahead[1] and chr(tail[0]) + chr(tail[1]) in ("re", "ve", "ll") else 0
            if size:
                starts[q + 1 : q + 1 + size] = False
                if q + 1 + size < n:
                    starts[q + 1 + size] = True
    return starts


def _chunks(texts: list[str]):
    """Groups of whole texts of about CHUNK characters, in their order, as ``(parts, index of each part's text)``.

    A longer text is cut before a blank that follows a non-blank: a word
    starts there whatever comes before.
    """
    parts, owner, size = [], [], 0
    for i, t in enumerate(texts):
        while len(t) > CHUNK:
            cut = next((k for k in range(CHUNK, len(t)) if t[k] in " \n" and not t[k - 1].isspace()), None)
            if cut is None:
                break
            if parts:
                yield parts, owner
                parts, owner, size = [], [], 0
            yield [t[:cut]], [i]
            t = t[cut:]
        if size + len(t) > CHUNK and parts:
            yield parts, owner
            parts, owner, size = [], [], 0
        parts.append(t)
        owner.append(i)
        size += len(t)
    if parts:
        yield parts, owner


def _byte_offsets(points: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Where in UTF-8 the code points at ``places`` begin."""
    size = np.ones(len(points) + 1, np.uint8)
    for limit in (0x80, 0x800, 0x10000):
        size[1:] += points >= limit
    size[0] = 0
    return np.cumsum(size, dtype=np.int64)[places]


def split_words(texts: list[str]):
    """Yield ``(Words, owners)`` for chunks of the batch, in order.

    Words are told apart by their bytes, in an Arrow dictionary: they lie end
    to end in the chunk's UTF-8, so its buffer and their offsets are the column.
    """
    for parts, owner in _chunks(texts):
        text = "".join(parts)
        lengths = np.array([len(p) for p in parts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        if not len(points):
            yield Words([], np.zeros(0, np.int64), np.zeros(len(parts), np.int64)), owner
            continue
        first = np.zeros(len(points) + 1, bool)
        first[bounds[:-1]] = True
        starts = np.flatnonzero(word_starts(points, first[:-1]))
        offsets = _byte_offsets(points, np.append(starts, len(points)))
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text.encode())])
        coded = column.dictionary_encode()
        at = np.searchsorted(starts, bounds)
        yield Words(coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), np.diff(at)), owner
