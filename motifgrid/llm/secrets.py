"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import join_groups, stage, trim

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A private key from its first to its last line; without a last line, the header, header fields and base64 lines that follow.
PEM = re.compile(
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:(?P<body>(?:[^-]|-(?!----))*+)-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?P<rest>(?:(?:[\s\"'>+,]|\\[nrt])*+(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*+|[A-Za-z0-9+/]{16,}+={0,2}))*+(?:(?:\s|\\[nrt])++[A-Za-z0-9+/]{1,15}+={0,2}(?=\s*\Z|[ \t\"']*[\r\n]))?))"
)
#: What differs between two ways of writing one key: line ends, also escaped ones, and quotes.
WRAPPING = re.compile(r"\\[nrt]|[\s\"']")
#: A run of a value's characters that may be a known secret without its name, if it has letters and digits.
BARE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}+")
#: Kinds beyond the three base ones, in the order in which they sort. Their spans count if ownership says that they are live.
MORE = (
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")),
    ("pem", PEM),
    ("login", re.compile(r"[a-z][a-z0-9+.-]{0,20}://[^\s:/@]{1,64}:[^\s:/@]{6,128}@")),
)
KINDS = ("assign", "access", "hex", *[k for k, _ in MORE], "bare")
BASE = 3

#: A value that this many owners hold is a copied example; below that entropy (bits a character) it is a placeholder.
EXAMPLE_OWNERS = 5
LIVE_ENTROPY = 2.5

FINDING = pa.struct([("start", pa.int32()), ("k", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("entropy", pa.float64())])
SCANNED = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("findings", pa.list_(FINDING))])
SCANNED_SQL = "n_assign long, n_access long, n_hex long, base_sha256 string, findings array<struct<start:int,k:int,end:int,hash:string,entropy:double>>"

#: Texts whose results a worker holds as Python objects at once.
HELD = 500


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def _value(m: re.Match) -> str:
    """What is owned: of a private key its body, otherwise the whole match."""
    return WRAPPING.sub("", m["body"] or m["rest"] or "") if m.re is PEM else m[0]


def find_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind, end, value)`` in code points, end exclusive, by start then kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    for k, (_, pattern) in enumerate(MORE, BASE):
        found += [(m.start(), k, m.end(), _value(m)) for m in pattern.finditer(text)]
    return sorted(found)


def bare_values(text: str, found: list) -> list[tuple[int, int, int, str]]:
    """As ``find_spans``: values outside the spans found that ownership may know from elsewhere."""
    out, k, end = [], 0, 0
    for m in BARE.finditer(text):
        while k < len(found) and found[k][0] < m.end():
            end, k = max(end, found[k][2]), k + 1
        if m.start() >= end and any(map(str.isdigit, m[0])) and any(map(str.isalpha, m[0])):
            out.append((m.start(), len(KINDS) - 1, m.end(), m[0]))
    return out


def _line(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in found)


def _scanned_text(text: str) -> tuple:
    found = find_spans(text)
    base = [x for x in found if x[1] < BASE]
    n = Counter(x[1] for x in base)
    listed = [(a, k, b, hashlib.sha256(v.encode()).hexdigest(), entropy(v)) for a, k, b, v in found + bare_values(text, found)]
    return n[0], n[1], n[2], hashlib.sha256(_line(base).encode()).hexdigest(), listed


def _by_parts(n: int, part, kind: pa.DataType) -> pa.Array:
    """``part(start, end)`` for the rows of a batch, some at a time: as Python objects, only these are held."""
    done = pa.concat_arrays([pa.array(part(k, min(n, k + HELD)), kind) for k in range(0, n, HELD)]) if n else pa.array([], kind)
    trim()
    return done


def scan_batch(body: pa.Array) -> pa.Array:
    """The scan's columns (SCANNED) of each text; only one text at a time leaves the batch."""
    return _by_parts(len(body), lambda a, b: [_scanned_text(body[i].as_py() or "") for i in range(a, b)], SCANNED)


def mask_batch(body: pa.Array, cut: pa.Array, mask: str) -> pa.Array:
    """The texts with their spans (ascending) masked, overlapping ones as one; a null text stays null."""

    def masked(t: str | None, spans: list | None) -> str | None:
        if t is None:
            return None
        parts, end = [], 0
        for s in spans or ():
            if s["start"] >= end:
                parts += [t[end : s["start"]], mask]
            end = max(end, s["end"])
        return "".join([*parts, t[end:]])

    return _by_parts(len(body), lambda a, b: [masked(body[i].as_py(), cut[i].as_py()) for i in range(a, b)], pa.string())


def ownership(findings: DataFrame) -> DataFrame:
    """``hash -> n_found, n_repos, n_owners, entropy, named, live`` over (hash, repo, owner, entropy, named) rows.

    Rows are reduced to distinct (hash, owner, repo) before anything is
    counted, and each count combines on the map side, so a value that a third
    of all documents copy is as cheap as any other. A value is live if few
    owners hold it, it is no placeholder, and some row names it as a secret.
    """
    best = F.max("entropy").alias("entropy"), F.max("named").alias("named")
    one = findings.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"), *best)
    two = one.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"), *best)
    all_ = two.groupBy("hash").agg(F.sum("n").alias("n_found"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), *best)
    return all_.withColumn("live", F.col("named") & (F.col("n_owners") < EXAMPLE_OWNERS) & (F.col("entropy") >= LIVE_ENTROPY))


def _scanned(docs: DataFrame, doc_id: str, text: str, owner: str | None, keep: bool) -> DataFrame:
    """Staged: the scan's columns beside uid, doc_id, owner and, to ``keep``, the whole row as ``_mg_row``.

    A row waits in the JVM while Python has its text, so it holds the text once.
    """
    holder = F.col(owner).cast("string") if owner else F.lit(None).cast("string")
    own = F.col(doc_id).alias("doc_id"), F.coalesce(holder, F.lit("")).alias("owner"), F.monotonically_increasing_id().alias("uid")
    if keep:
        base, body = docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_mg_row")), F.col("_mg_row")[text]
    else:
        base, body = docs.select(*own, F.col(text).alias("body")), F.col("body")

    @F.arrow_udf(SCANNED_SQL)
    def scan_text(body: pa.Array) -> pa.Array:
        return scan_batch(body)

    return stage(base.withColumn("s", scan_text(body)).select("uid", "doc_id", "owner", "s.*", *["_mg_row"] * keep))


def _verdicts(scanned: DataFrame) -> DataFrame:
    """Every finding (uid, start, k, end, live, named, n_owners, n_repos)."""
    each = scanned.where(F.size("findings") > 0).select("uid", F.col("doc_id").alias("repo"), "owner", F.explode("findings").alias("f")).select("uid", "repo", "owner", "f.*")
    each = each.withColumn("named", F.col("k") < len(KINDS) - 1)
    known = stage(ownership(each))
    total = known.agg(F.sum("n_found")).first()[0] or 0
    return join_groups(each.drop("entropy", "repo", "owner", "named"), known.drop("entropy"), "hash", "n_found", total)


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str | None = "source") -> DataFrame:
    """One row per document with its spans and how its candidates are owned.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and
    n_live, n_example (findings by corpus-wide ownership). Base spans are
    listed whoever owns them. Further kinds, and values without a name that
    are named elsewhere, are listed if ownership says live: a value that
    EXAMPLE_OWNERS owners hold is a copied example.

    A document stands for a repository and ``owner`` for its owner; a null
    owner is the owner ''. A null or empty text has no spans, a long one is
    read whole. Rows repeat as often as they occur; rows repeated with one id
    count as one repository. Other columns are not read, whatever their
    names. An empty table gives an empty result.
    """
    scanned = _scanned(docs, doc_id, text, owner, keep=False)
    found = _verdicts(scanned).where("named")
    span = F.struct("start", "k", "end")
    listed = F.collect_list(F.when((F.col("k") < BASE) | F.col("live"), span))
    per_doc = found.groupBy("uid").agg(F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"), F.array_sort(listed).alias("listed"))
    out = scanned.drop("findings", "owner").join(per_doc, "uid", "left")
    zero = F.lit(0).cast("long")
    names = F.array(*[F.lit(k) for k in KINDS])
    lines = F.transform(F.coalesce("listed", F.array().cast("array<struct<start:int,k:int,end:int>>")), lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"], s["end"]))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(lines, ",").alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str | None = "source", mask: str = "[SECRET]") -> DataFrame:
    """The documents, in their own columns, with live-looking values masked in the text.

    A live value is masked wherever it stands, also without its name.
    Overlapping spans are masked as one. Widely copied examples and
    placeholders stay. Documents without a live finding come out unchanged,
    and no document is dropped. ``n_chars``, if present, follows the text.
    """
    cols = docs.columns
    scanned = _scanned(docs, doc_id, text, owner, keep=True)
    found = _verdicts(scanned).where("live")
    spans = found.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut"))
    joined = scanned.select("uid", "_mg_row", F.size("findings").alias("n"))
    clean = joined.where("n = 0").select("_mg_row.*")
    dirty = joined.where("n > 0").join(spans, "uid", "left")

    @F.arrow_udf("string")
    def masked(body: pa.Array, cut: pa.Array) -> pa.Array:
        return mask_batch(body, cut, mask)

    # Texts with nothing to mask stay in the JVM.
    cut, body = F.col("cut"), F.col("_mg_row")[text]
    fixed = dirty.withColumn("_mg_text", F.when(cut.isNull(), body).otherwise(masked(F.when(cut.isNotNull(), body), cut)))
    new = {text: F.col("_mg_text")}
    if "n_chars" in cols:
        new["n_chars"] = F.when(F.col("cut").isNull(), F.col("_mg_row.n_chars")).otherwise(F.length("_mg_text").cast(docs.schema["n_chars"].dataType))
    fixed = fixed.select(*[new.get(c, F.col(f"_mg_row.`{c}`")).alias(c) for c in cols])
    return clean.unionByName(fixed)
