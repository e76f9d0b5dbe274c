"""Quality rules: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import SPACE_CLASS, bind

SYMBOLS = "#*$%&|<>"
WINDOW = 5
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is it that was for on are with as be at by this from or an a "
    "der die das und zu im den von mit des auf für ist nicht ein eine dem sich er es "
    "le la les de et un une en que qui pour dans du est sur au pas par avec "
    "el los las y del se por con para una su al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= scale * top / bottom <= high``, on whole numbers; a zero bottom passes.

    ``from_words``: the rule holds for texts of that many words and more.
    """

    name: str
    top: str
    bottom: str
    low: int | None = None
    high: int | None = None
    scale: int = 100
    from_words: int = 0

    def passes(self) -> Column:
        top, bottom = F.col(self.top) * self.scale, F.col(self.bottom)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (top >= bottom * self.low)
        if self.high is not None:
            ok = ok & (top <= bottom * self.high)
        return (F.col("n_words") < self.from_words) | (bottom == 0) | ok


#: The production table. Ratios are in hundredths.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=200, high=1200),
    Rule("symbol_ratio", "n_symbols", "n_words", high=10),
    Rule("stop_word_ratio", "n_stop_words", "n_words", low=2, from_words=50),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", high=40),
    Rule("line_length", "n_lines", "n_words", high=60, from_words=50),
)


def _repeated_words(words: Column, hashes: Column) -> Column:
    """Words covered by 5-word windows found twice or more.

    Equal windows have equal hashes, so a text whose hashes all differ has
    none.  The others sort the windows themselves (text, then place): equal
    ones become neighbours, whose places are merged from left to right.
    """
    at = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    windows = F.array_sort(F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i, WINDOW)).alias("w"), i.alias("i"))))

    def neighbours(s: Column) -> Column:
        def twice(x, i):
            before = F.when(i > 0, F.get(s, i - 1)["w"])
            return F.coalesce(F.get(s, i + 1)["w"] == x["w"], F.lit(False)) | F.coalesce(before == x["w"], F.lit(False))

        return F.filter(s, twice)

    places = F.array_sort(F.transform(F.flatten(F.transform(F.array(windows), neighbours)), lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(1).alias("end"))

    def cover(acc, i):
        grown = acc["n"] + (i + WINDOW - F.greatest(i, acc["end"])).cast("long")
        return F.struct(grown.alias("n"), (i + WINDOW).alias("end"))

    counted = F.aggregate(places, start, cover, lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), counted).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that the rules read; other columns stay.

    Words are runs of anything but space and the ASCII controls 9 to 13. A
    null or empty text has no words and counts of 0. Repeated rows are
    measured one by one. Columns of the counts' names are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_stop_words", "n_repeat_words"]
    docs = docs.drop(*names)
    body = F.coalesce(F.col(text), F.lit(""))
    seen = bind(
        docs,
        _mg_words=F.array_remove(F.split(body, f"[{SPACE_CLASS}]+"), ""),
        _mg_lines=F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")),
        n_symbols=(F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]+", ""))).cast("long"),
        word_chars=F.length(F.regexp_replace(body, f"[{SPACE_CLASS}]+", "")).cast("long"),
    )
    words, lines = F.col("_mg_words"), F.col("_mg_lines")
    n = F.size(words)
    at = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    stops = F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))
    seen = bind(
        seen,
        _mg_hashes=hashes,
        n_words=n.cast("long"),
        n_lines=F.size(lines).cast("long"),
        n_dup_lines=(F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        n_stop_words=F.size(stops).cast("long"),
    )
    seen = seen.withColumn("n_repeat_words", _repeated_words(words, F.col("_mg_hashes")))
    return seen.drop("_mg_words", "_mg_lines", "_mg_hashes")


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the counts, ``base_failed``, one verdict column and ``kept``.

    ``failed_rule`` names the first rule of the table that fails, else null.
    Everything is one projection over the scan: no shuffle, no user function.
    """
    out = measure(docs.drop("base_failed", "failed_rule", "kept"), text)
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    first = F.coalesce(*[F.when(~r.passes(), F.lit(r.name)) for r in rules], F.lit(None).cast("string"))
    out = out.withColumn("base_failed", base).withColumn("failed_rule", first)
    return out.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with the columns they came with."""
    own = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_mg_row"), F.col(text).alias("_mg_text"))
    return judge(held, "_mg_text").where("kept").select("_mg_row.*")
