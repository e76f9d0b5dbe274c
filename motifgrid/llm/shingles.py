"""Word shingles of whole texts as sorted 64-bit hashes, by array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

CHUNK = 1_000_000


def _weights(n: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


#: Words of more bytes are hashed one by one.
LONG_WORD = 128
_HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``raw[start:end]``, which depends on these bytes alone.

    Eight bytes of every word are folded in at a time; a fold is one-to-one in
    them, and multiplications and shifts take turns, so the hash is no
    polynomial of the letters and words of up to eight bytes never collide.
    """
    every8 = np.ndarray((len(raw),), "<u8", buffer=raw + bytes(8), strides=(1,))
    sizes = ends - starts
    h = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    live = np.flatnonzero(sizes <= LONG_WORD)
    at, left = starts[live], sizes[live]
    while len(live):
        x = h[live] ^ (every8[at] & _HEADS[np.minimum(left, 8)])
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h[live] = x ^ (x >> np.uint64(32))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return h


def _of_chunk(texts: list[bytes], width: int) -> list[np.ndarray]:
    raw = b"\n".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.cumsum(sizes + 1)
    data = np.frombuffer(raw, np.uint8)
    word = (data != 32) & ((data < 9) | (data > 13))
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    w = word_hashes(raw, starts, ends)
    first = np.concatenate([[0], np.searchsorted(starts, bounds)])
    c = _weights(width)
    n = max(0, len(w) - width + 1)
    rows = np.zeros(n, np.uint64)
    for k in range(width):
        rows += w[k : k + n] * c[k]
    rows = mix(rows)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rows[a : b - width + 1]))
        elif b > a:  # the whole sequence as one; its length is part of the hash
            out.append(mix(np.array([(w[a:b] * c[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The set of each text: A-Z lower-cased, words between ASCII blanks, distinct
    ``width``-word shingles, ascending. With fewer words the whole sequence is
    one shingle; without words (or null) the set is empty."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        b = (t or "").encode().lower()
        if held and size + len(b) > CHUNK:
            yield from _of_chunk(held, width)
            held, size = [], 0
        held.append(b)
        size += len(b)
    if held:
        yield from _of_chunk(held, width)
