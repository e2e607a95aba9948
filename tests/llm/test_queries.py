import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from cathlight.llm import queries
from tests.oracle import DATA, duck, spark_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def result(spark, name):
    return {r[0]: r for r in queries.QUERIES[name](spark, DATA).collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, DATA)) == duck(queries.SQL[name])


def test_op1_same_as_library(spark, docs):
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = result(spark, "op1_sentencepiece")
    for i, t in docs.items():
        ids = coder.encode(t)
        assert got[i].n_ids == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and got[i].round_trip


def shingles(t, k):
    w = WORD.findall(t.translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(docs, k):
    sets = {i: shingles(t, k) for i, t in docs.items()}
    of = {i: i for i in docs}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                of[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in docs}


def test_op2_same_as_brute_force(spark, docs):
    assert {i: tuple(r[1:]) for i, r in result(spark, "op2_minhash_near_dedup").items()} == classes(docs, 4)


def test_op5_base_same_as_brute_force(spark, docs):
    for i, r in result(spark, "op5_quality_rules").items():
        t = docs[i]
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        near = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert tuple(r)[1:6] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(near))
        assert r.base_failed == (len(w) < 50 or 100 * len(near) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_op6_pieces(spark, docs):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.QUERIES["op6_retrieval_packing"](spark, DATA).collect()
    own, sequences = {}, {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(own) == set(docs)
    for i, t in docs.items():
        ids, at = np.array([*coder.encode(t, add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(own[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0 or at == 1024


def test_op7_held_out(spark):
    got = result(spark, "op7_toxicity")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    clean = [got[i].predicted for i, y in labels.items() if y == 0]
    assert sum(clean) <= 0.02 * len(clean)


def test_op8_base_same_as_brute_force(spark, docs):
    import math

    words = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in docs.items()}
    c = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, r in result(spark, "op8_suffix_tree_lm").items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[i])
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.n_known == sum(c[w] > 0 for w in words[i]) and r.n_tokens == len(words[i])
        assert r.train_tokens == n and r.score < 0


def removed(docs, length=100):
    seen, out = set(), {}
    for i in sorted(docs):
        b = docs[i].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_op9_same_as_brute_force(spark, docs, monkeypatch):
    from cathlight.llm import suffix_dedup

    want = removed(docs)
    assert {i: tuple(r[1:]) for i, r in result(spark, "op9_suffix_dedup").items()} == want
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    assert {i: tuple(r[1:]) for i, r in result(spark, "op9_suffix_dedup").items()} == want


@pytest.mark.parametrize("hot,limit", [(20_000, 1 << 24), (2, 0)])
def test_op9_of_periodic_and_overlapping_texts(spark, monkeypatch, hot, limit):
    from pyspark.sql import functions as F

    from cathlight.llm import suffix_dedup

    rng, passage = np.random.default_rng(hot), "".join(f"{i * i % 89:02d}" for i in range(120))
    texts = {}
    for i in range(60):
        own = "".join(map(str, rng.integers(0, 2, int(rng.integers(0, 90)))))
        a = int(rng.integers(0, 120))
        parts = [own, passage[a : a + int(rng.integers(40, 240))], "ab" * int(rng.integers(0, 90)), own[:70], passage[: int(rng.integers(0, 200))]]
        texts[i] = "".join(parts[k] for k in rng.permutation(5))
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "FILTER", limit)
    rows = [*texts.items(), *list(texts.items())[:5]]  # some rows twice
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).withColumn("sha", F.sha2("kept_bytes", 256))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got.collect()} == removed(texts)
