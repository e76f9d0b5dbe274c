"""Toxicity: restore disguised words through a noisy channel, then score them."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import stage, trim

#: Bound on the labelled rows that the classifier is fitted on (the first by a hash of their id).
MAX_LABELLED = 20_000
#: Cells of the table of character n-grams, that all tasks hold: 8 MB. Every
#: n-gram of every text counts in the cell of its hash.
CELLS = 1 << 20
#: Beginnings of words that count as features beside the words, marked by a star: inflected forms share them.
STEMS = range(4, 9)
#: A feature enters the lexicon from this many toxic training documents and this share of them, this many times as frequent there.
MIN_TOXIC_DOCS = 4
MIN_TOXIC_SHARE = 0.01
MIN_RATIO = 20.0
#: Pull of each weight towards its word's log-ratio.
RIDGE = 0.05

# Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Log-probabilities of the channel: a letter written as a sign, doubled, or set apart.
LOG_SIGN, LOG_REPEAT, LOG_SPACE, LOG_KEEP = math.log(0.05), math.log(0.05), math.log(0.02), math.log(0.9)

LETTER = r"[^\W\d_]"
SIGN = r"[0-9@$!|+(<€£¡]"
WORD = re.compile(LETTER + "+")
SIGNS = re.compile(SIGN)
THRICE = re.compile(rf"({LETTER})\1\1")
#: Single letters or signs set apart by blanks or marks, between characters that are neither letters nor digits.
ONE = r"(?:[^\W_]|[@$!|+(<€£¡])"
SPACED = re.compile(rf"(?<![^\W_]){ONE}(?:[ .\-_*]{ONE}){{2,}}(?![^\W_])")
CACHE_TOKENS = 1_000_000


def _cell(gram: str) -> int:
    """The cell of an n-gram, as ``pmod(xxhash64(gram), CELLS)`` gives it."""
    return xxhash.xxh64_intdigest(gram.encode(), 42) & (CELLS - 1)


@dataclass
class CharModel:
    """Interpolated character trigrams: ``counts`` by the cells of up to three characters, ``total`` of single ones."""

    counts: np.ndarray
    total: int

    def __post_init__(self) -> None:
        self.cache: dict[str, float] = {}

    def _count(self, gram: str) -> int:
        return int(self.counts[_cell(gram)])

    def log(self, before: str, c: str) -> float:
        key = before[-2:] + c
        got = self.cache.get(key)
        if got is None:
            if len(self.cache) > CACHE_TOKENS:
                self.cache.clear()
            n = self._count
            p = 0.1 * (n(c) + 0.5) / (self.total + 50)
            if before:
                p += 0.3 * n(before[-1] + c) / (n(before[-1]) + 1)
            if len(before) > 1:
                p += 0.6 * n(key) / (n(before[-2:]) + 1)
            got = self.cache[key] = math.log(p)
        return got


def lattice(run: str) -> list[list[tuple[str, float]]]:
    """For each written character, the letters it may stand for and their costs ('' is noise)."""
    out = []
    previous = ""
    for c in run:
        ways: list[tuple[str, float]] = []
        if c.isalpha():
            ways.append((c, LOG_KEEP))
            if c == previous:
                ways.append(("", LOG_REPEAT))
        for letter in LEET.get(c, ""):
            ways.append((letter, LOG_SIGN))
        if not c.isalpha():
            ways.append(("", LOG_SPACE if c in " .-_*" else LOG_SIGN + LOG_REPEAT))
        out.append(ways)
        previous = c
    return out


def suspect(token: str) -> bool:
    """Whether a token may be disguised: letters and a sign, wherever, or a letter three times."""
    return bool(SIGNS.search(token) and WORD.search(token) or THRICE.search(token))


def _unspaced(c: str) -> bool:
    """A letter of the scripts that are written without blanks; it and any other may be of two words."""
    return "\u0e00" <= c < "\u1c80" or c >= "\u2e80"


def decode(run: str, model: CharModel, lexicon: frozenset[str] = frozenset()) -> list[str]:
    """The likeliest words behind a run, in order: Viterbi over the lattice.

    A word is either spelt letter by letter under the character model, whose
    state is its last two letters (all that the model looks at), or is a
    lexicon word, whose state is its letters so far and which must be whole
    where it ends. Words end at the end of the run, at a character taken as
    noise that is no letter, and between scripts. The best path into each
    state is kept, and no state is dropped; the work is linear in the run. A
    run that spells one lexicon word is taken as that word first. A path is a
    chain of (path before, letter); the letter '' ends a word.
    """
    prefixes = _prefixes(lexicon)
    log_known = math.log(0.6)
    run = run.lower()
    # The key is (last two letters, None) or (letters so far, True); at the start of a word both are ''.
    states: dict[tuple[str, bool | None], tuple[float, tuple | None]] = {("", None): (0.0, None), ("", True): (0.0, None)}
    single: dict[str, tuple[float, tuple | None]] = {"": (0.0, None)}  # paths that have spelt one lexicon word so far
    previous = ""
    for c, ways in zip(run, lattice(run), strict=True):
        between = previous.isalpha() and c.isalpha() and _unspaced(previous) != _unspaced(c)
        if between:
            _restart(states, states, 0.0, lexicon)
        following: dict[tuple[str, bool | None], tuple[float, tuple | None]] = {}
        for (tail, known), (score, path) in states.items():
            for letter, cost in ways:
                step, key, new = score + cost, (tail, known), path
                if letter:
                    new = (path, letter)
                    if known:
                        if tail + letter not in prefixes:
                            continue
                        step, key = step + log_known, (tail + letter, True)
                    else:
                        step, key = step + model.log(tail, letter), ((tail + letter)[-2:], None)
                if key not in following or following[key][0] < step:
                    following[key] = (step, new)
        if not c.isalpha():
            _restart(states, following, ways[-1][1], lexicon)
        if single:
            ahead: dict[str, tuple[float, tuple | None]] = {}
            for start, (score, path) in single.items():
                for letter, cost in ways:
                    if start + letter in prefixes and (start + letter not in ahead or ahead[start + letter][0] < score + cost):
                        ahead[start + letter] = (score + cost, (path, letter) if letter else path)
            single = ahead
        states, previous = following, c
    whole = [(x[0], w) for w, x in single.items() if w in lexicon]
    if whole:
        return [max(whole)[1]]
    ends = [x for (tail, known), x in states.items() if not known or not tail or tail in lexicon]
    path = max(ends, key=lambda x: x[0])[1]
    letters = []
    while path is not None:
        path, letter = path
        letters.append(letter or " ")
    return "".join(reversed(letters)).split()


def _restart(states: dict, into: dict, cost: float, lexicon: frozenset[str]) -> None:
    """Let words end in ``states``: the best path that can goes on at the start of a word in ``into``."""
    ends = [x for (tail, known), x in states.items() if tail and (not known or tail in lexicon)]
    if not ends:
        return
    score, path = max(ends, key=lambda x: x[0])
    for known in (None, True):
        key = ("", known)
        if key not in into or into[key][0] < score + cost:
            into[key] = (score + cost, (path, ""))


@functools.lru_cache(8)
def _prefixes(lexicon: frozenset[str]) -> frozenset[str]:
    return frozenset(w[:i] for w in lexicon for i in range(1, len(w) + 1)) | {""}


class Reader:
    """Words of texts with disguised runs restored; what a token holds is worked out once.

    A run is written plainly where the likeliest reading has a word of the
    lexicon, and otherwise stays as it is. ``of`` turns a token's words into
    what is kept of it.
    """

    def __init__(self, model: CharModel, lexicon: frozenset[str], of=frozenset):
        self.model, self.lexicon, self.of = model, lexicon, of
        self.tokens: dict[str, frozenset] = {}
        self.empty: set[str] = set()
        self.runs: dict[str, str] = {}

    def _plain(self, run: str) -> str:
        """The run, restored."""
        words = decode(run, self.model, self.lexicon)
        return " ".join(words) if not self.lexicon.isdisjoint(words) else run

    def _run(self, m: re.Match) -> str:
        run = m[0]
        if run not in self.runs:
            self.runs[run] = self._plain(run) if WORD.search(run) else run
        return self.runs[run]

    def restore(self, text: str) -> str:
        """The text with its disguised runs written plainly."""
        return re.sub(r"\S+", lambda m: self._plain(m[0]) if suspect(m[0]) else m[0], SPACED.sub(self._run, text)) if self.lexicon else text

    def read(self, text: str) -> set[str]:
        """What ``of`` keeps of the words of the restored text."""
        if len(self.tokens) + len(self.empty) + len(self.runs) > CACHE_TOKENS:
            self.tokens.clear()
            self.empty.clear()
            self.runs.clear()
        found: set[str] = set()
        for token in set((SPACED.sub(self._run, text) if self.lexicon else text).split()) - self.empty:
            got = self.tokens.get(token)
            if got is None:
                plain = self._plain(token) if self.lexicon and suspect(token) else token
                got = frozenset(self.of(set(WORD.findall(plain.lower()))))
                if got:
                    self.tokens[token] = got
                else:
                    self.empty.add(token)
            found |= got
        return found


def features(words: set[str]) -> set[str]:
    """The words and their stems."""
    return words | {f"{w[:k]}*" for w in words for k in STEMS if k < len(w)}


@dataclass
class Model:
    """A lexicon of words and stems with weights, a bias, and the character model."""

    weights: dict[str, float]
    bias: float
    chars: CharModel

    @property
    def lexicon(self) -> frozenset[str]:
        """Whole words, towards which disguised runs are restored."""
        return frozenset(w for w in self.weights if not w.endswith("*"))

    def reader(self) -> Reader:
        known = frozenset(self.weights)
        starts = {f.rstrip("*")[: STEMS[0]] for f in known}

        def of(words: set[str]) -> set[str]:
            near = {w for w in words if w[: STEMS[0]] in starts}
            return features(near) & known if near else near

        return Reader(self.chars, self.lexicon, of)

    def score(self, found: set[str]) -> float:
        """From what the reader found in a text."""
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id_column):
    """Rows whose crc32(doc_id as text) mod 3 is 1 never teach."""
    return F.coalesce(F.pmod(F.crc32(doc_id_column.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Character 1- to 3-gram counts of words, summed per batch."""
    for batch in batches:
        words: Counter = Counter()
        for t in batch.column(0).to_pylist():
            if t:
                words.update(t.lower().split())
        grams: Counter = Counter()
        for token, n in words.items():
            for w in WORD.findall(token):
                for k in (1, 2, 3):
                    for i in range(len(w) - k + 1):
                        grams[w[i : i + k]] += n
        del words
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["gram", "n"])
    trim()


def char_model(texts: DataFrame, text: str = "text") -> CharModel:
    """Counts over every text; only the cells' sums reach the driver."""
    grams = texts.select(text).mapInArrow(_ngrams, "gram string, n long")
    cells = grams.groupBy(F.pmod(F.xxhash64("gram"), F.lit(CELLS)).cast("int").alias("cell"), (F.length("gram") == 1).alias("single")).agg(F.sum("n").alias("n"))
    found = cells.toArrow()
    cell, single, n = (found.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    counts = np.zeros(CELLS, np.int64)
    np.add.at(counts, cell.astype(np.int64), n.astype(np.int64))
    return CharModel(counts, int(n[single.astype(bool)].sum()) or 1)


def _count_features(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Documents per feature and label, summed per batch; the documents' own number is feature ''."""
    reader = Reader(*shared.value, features)
    for batch in batches:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for t, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[int(bool(toxic))].update(reader.read(t or "") | {""})
        rows = [(f, k, n) for k, c in counts.items() for f, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["f", "toxic", "n"])


def _hits(batches: Iterator[pa.RecordBatch], shared, listed: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """The features of the lexicon that each document has."""
    reader = Reader(*shared.value, lambda words: features(words) & listed)
    for batch in batches:
        sets = [sorted(reader.read(t or "")) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.string())), batch.column(1)], ["hits", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MAX_LABELLED) -> Model:
    """Learn from labelled rows that are not held out, at most ``most`` of them.

    Words far more frequent in toxic documents form the lexicon, however many;
    a logistic regression on their presence gives weights. The character model counts
    every document's text. Words are first found plainly, then once more with
    disguised runs restored towards that lexicon.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null")
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    train = stage(rows.join(F.broadcast(picked), "_id").select("_id", "text", "toxic"))
    chars = char_model(docs, text)
    model = Model({}, -5.0, chars)
    for _ in range(2):
        shared = spark.sparkContext.broadcast((chars, model.lexicon))
        texts = train.select("text", "toxic")
        counted = texts.mapInArrow(lambda it, b=shared: _count_features(it, b), "f string, toxic int, n long")
        each = stage(counted.groupBy("f").agg(F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum("n").alias("n")))
        all_ = each.where("f = ''").first()
        bad, good = (all_["t"], all_["n"] - all_["t"]) if all_ else (0, 0)
        if not bad or not good:
            return Model({}, 5.0 if bad else -5.0, chars)
        ratio = ((F.col("t") + 0.5) / bad) / ((F.col("n") - F.col("t") + 0.5) / good)
        enough = F.col("t") >= max(MIN_TOXIC_DOCS, MIN_TOXIC_SHARE * bad)
        top = each.where((F.col("f") != "") & enough & (ratio >= MIN_RATIO)).withColumn("gain", F.col("t") * F.log(ratio))
        ratios = {r["f"]: r["ratio"] for r in top.withColumn("ratio", F.log(ratio)).orderBy(F.desc("gain"), "f").collect()}
        if not ratios:
            return Model({}, -5.0, chars)
        listed = frozenset(ratios)
        found = texts.mapInArrow(lambda it, b=shared, x=listed: _hits(it, b, x), "hits array<string>, toxic int")
        facts = found.groupBy("toxic", "hits").agg(F.count("*").alias("n")).toPandas()
        weights, bias = _logistic(facts, ratios)
        model = Model(weights, bias, chars)
    return model


def _logistic(facts: pd.DataFrame, ratios: dict[str, float], steps: int = 400) -> tuple[dict[str, float], float]:
    """Ridge logistic regression on presence of words, by gradient steps over
    distinct rows. Each weight is pulled towards its word's own log-ratio of
    document frequencies, which is all that rows without other words say."""
    lexicon = list(ratios)
    at = {w: i for i, w in enumerate(lexicon)}
    rows = np.repeat(np.arange(len(facts)), [len(h) for h in facts["hits"]])
    cols = np.array([at[w] for h in facts["hits"] for w in h], np.int64)
    y, n = facts["toxic"].to_numpy(float), facts["n"].to_numpy(float)
    centre = np.array([ratios[w] for w in lexicon])
    w, bias = centre.copy(), -4.0
    speed_w, speed_b = np.full(len(lexicon), 1e-8), 1e-8
    for _ in range(steps):
        z = bias + np.bincount(rows, w[cols], len(y))
        error = n * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw, gb = np.bincount(cols, error[rows], len(w)) + RIDGE * (w - centre), error.sum()
        speed_w, speed_b = speed_w + gw**2, speed_b + gb**2
        w, bias = w - 0.5 * gw / np.sqrt(speed_w), bias - 0.5 * gb / np.sqrt(speed_b)
    return dict(zip(lexicon, w.tolist(), strict=True)), float(bias)


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    reader = model.reader()
    for batch in batches:
        scores = [model.score(reader.read(t or "")) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Only the text is an input of the score; equal texts score alike, and rows
    repeat as they come. Empty and null texts score the bias alone, long ones
    and long tokens are read whole. A score at the threshold predicts 1.
    Without labels of both kinds every document scores alike. Other columns
    are not read, whatever their names. An empty table gives an empty result.
    """
    model = fit(docs, labels, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    scored = docs.select(F.col(doc_id), F.col(text)).mapInArrow(lambda it: _score(it, shared), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
