import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from test_operators import jaccard_brute
from tokenizers import Tokenizer

import corpus_pipeline
from motifgrid.llm import bpe, quality
from motifgrid.llm.support import stage


def test_stages(spark, tmp_path):
    base = ["the cat of the house and the river is blue as a tree by the stone " + f"w{i} x{i} y{i} z{i} q{i}" for i in range(6)]
    long = " ".join(f"the n{i} of" for i in range(60))
    texts = [*base, base[0], long, long + " tail", "$$$ ### %%% a b c d e f g h", None, "the key token = 'k3yV4lu3XyZ99' of the house and the river is blue as a tree"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = []
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = stage(f(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids.append(sorted(r["doc_id"] for r in docs.collect()))
    assert ids[0] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 11]
    assert ids[1] == [1, 2, 3, 4, 5, 6, 7, 8, 11]
    assert ids[2] == ids[3] == [1, 2, 3, 4, 5, 6, 7, 11]
    assert "[SECRET]" in docs.where("doc_id = 11").first()["text"]
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted({r["doc_id"] for r in pieces.collect()}) == ids[3]


def test_run_against_brute_force(spark, tmp_path):
    """Every stage on all that its predecessor kept, in plain Python; null and repeated ids, and an extra column."""
    rnd = random.Random(41)
    words = "the of and house tree river stone cloud walk blue green is a to in".split()
    say = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "s", "er", "ing", str(rnd.randrange(40))]) for _ in range(n))
    texts = [say(rnd.randint(5, 90)) for _ in range(60)]
    for k in range(25):
        w = rnd.choice(texts[:60]).split()
        w[rnd.randrange(len(w))] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [rnd.choice(texts) for _ in range(20)] + [None, "", "the " * 50, "# $ % & " * 20, f"{say(30)} password = S3cretValue{rnd.randrange(10**6)} {say(20)}"]
    rows = [(i, t, "en", f"s{i % 7}", len(t or ""), "x") for i, t in enumerate(texts)] + [(None, say(40), "en", "s", 1, "x"), (3, say(40), "en", "s", 1, "x"), (3, texts[3], "en", "s3", 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))

    judged = {}
    for r in quality.judge(spark.createDataFrame(rows, schema)).collect():
        judged.setdefault(r["doc_id"], []).append(r["kept"])
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = stage(f(spark, docs, str(tmp_path)))
        assert docs.columns == schema.replace(",", "").split()[::2]
        seen.append([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert Counter(i for i, _ in seen[0]) == Counter({i: sum(k) for i, k in judged.items() if sum(k)})
    top = {}
    for i, t in seen[0]:
        top[t] = max(top.get(t, -1), -1 if i is None else i)
    assert Counter(seen[1]) == Counter((None if i < 0 else i, t) for t, i in top.items())
    parts = {}
    for (i, t), (_, _, c) in zip(seen[1], jaccard_brute([(n, t) for n, (_, t) in enumerate(seen[1])], 5, 80), strict=True):
        parts.setdefault(c, []).append((i is None, i or 0, hashlib.md5(t.encode()).digest(), t))
    assert Counter(seen[2]) == Counter((None if p[0] else p[1], p[3]) for p in map(min, parts.values()))
    assert len(seen[1]) > len(seen[2]) + 5
    masked = [(i, re.sub(r"password = S3cretValue\d+", "[SECRET]", t)) for i, t in seen[2]]
    assert Counter(seen[3]) == Counter(masked) and masked != seen[2]

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = Tokenizer.from_file(bpe.default_vocabulary())
    ids = {i: [*tokens.encode(t, add_special_tokens=False).ids, 1] for i, t in seen[3]}
    once = Counter(i for i, _ in seen[3])
    assert sum(r["length"] for r in pieces) == sum(len(tokens.encode(t, add_special_tokens=False).ids) + 1 for _, t in seen[3])
    for i, own in ids.items():
        if once[i] > 1:
            continue
        at = 0
        for r in sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(own[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(own)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
