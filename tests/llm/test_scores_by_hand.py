"""Toxicity scores and language features from plain loops; forced clashes of names; copies of queries that are sent."""

import math
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cathlight.llm import kernels as K
from cathlight.llm import language_id, suffix_dedup, topk_search, toxicity

M = (1 << 64) - 1
MULT = [int(x) for x in K.MULT]
R = 0x9E3779B97F4A7C15 | 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def hashed(word):
    return mixed(sum((b + 1) * pow(R, i, 1 << 64) for i, b in enumerate(word)) & M)


def toxic_features(text):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", lower) if w]
    h, out = [hashed(w) for w in words], set()
    for gaps in ((0,), (0, 1), (0, 2)):
        for i in range(len(h) - gaps[-1]):
            x = len(gaps) * 1000 + gaps[-1]
            for g, m in zip(gaps, MULT):
                x = (x + h[i + g]) * m & M
                x ^= x >> 29
            out.add(x >> 64 - toxicity.BITS)
    for most in toxicity.STEMS:
        out |= {mixed(hashed(w[:most]) + MULT[most] & M) >> 64 - toxicity.BITS for w in words}
    return sorted(out)


def test_toxicity_scores_from_texts(spark):
    texts = {i: f"{'Vile rubbish' if i % 3 == 0 else 'kind words'} number{i % 7} é{i} and so on" for i in range(60)} | {60: "", 61: None, 62: "one"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(45)] + [(3, 0), (None, 1), (61, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()}
    order = [r[0] for r in docs.where("doc_id < 45").orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").collect()]
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= toxicity.L1 else (math.copysign(toxicity.L1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    score = lambda t: 1 / (1 + math.exp(-sum(weight(i) for i in [*toxic_features(t or ""), "bias"])))
    for _ in range(toxicity.PASSES):
        for i in order:
            own = [*toxic_features(texts[i]), "bias"]
            g, w = score(texts[i]) - (i % 3 == 0), {f: weight(f) for f in own}
            for f in own:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * w[f]
                n[f] += g * g
    assert len(got) == len(texts) and all(abs(got[i] - score(t)) < 1e-9 for i, t in texts.items())


def test_toxicity_learns_from_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 5)
    docs = spark.createDataFrame([(1, f"same id {k}") for k in range(50)] + [(2, "other")], "doc_id long, text string")
    plan = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert "limit=5" in plan._jdf.queryExecution().toString() or "Limit 5" in plan._jdf.queryExecution().toString()
    assert plan.count() >= 0


def language_features(text, bits):
    low = text.lower()
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in f" {low} ")
    kept = __import__("re").sub(" +", " ", kept)
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(kept) - n + 1):
            if n == 1 and kept[i] == " ":
                continue
            x = 0
            for k, c in enumerate(kept[i : i + n]):
                x = (x + ord(c)) * MULT[k] & M
                x ^= x >> 32
            out[(x * MULT[6] & M) >> 64 - bits] += 1
    return out


def test_language_features():
    texts = ["Ich bin hier.", "", "  ", "é1ß  2", "İstanbul", "हिन्दी भाषा", "日本", "a", "x" * 3000]
    has, found = language_id.runs(texts, 16)
    for i, t in enumerate(texts):
        own = Counter()
        for f, doc in found:
            own.update(f[doc == i].tolist())
        assert own == language_features(t, 16) and has[i] == any(c.isalpha() for c in t)


def test_language_scores_from_texts(spark):
    words = {"xx": ["aba", "abba", "bab"], "yy": ["cdc", "dcd", "ccd"], "zz": ["efe", "ffe", "abe"]}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[k], 6)), k) for i, k in enumerate(list(words) * 20)] + [(100, None, "xx"), (101, "12 !", "yy"), (102, "aba cdc", None), (103, "", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = F.col("doc_id") < 45
    got = {r.doc_id: r for r in language_id.identified(docs, language_id.fit(docs, learn)).collect()}
    own = {i: language_features(t or "", 16) for i, t, _ in rows}
    taught = [r[0] for r in docs.where(learn).orderBy(F.xxhash64("doc_id")).select("doc_id").collect()]
    often = Counter(f for i in taught for f in own[i])
    value = lambda i: {f: language_id.SCALE * n / sum(own[i].values()) * (math.log((1 + len(taught)) / (1 + often[f])) + 1) for f, n in own[i].items()} | {"bias": 1.0}
    z, n = Counter(), Counter()
    step = language_id.CALIBRATE

    def weight(i):
        return 0.0 if abs(z[i]) <= language_id.L1 else (math.copysign(language_id.L1, z[i]) - z[i]) / ((language_id.BETA + math.sqrt(n[i])) / language_id.ALPHA + language_id.L2)

    names = sorted(words)
    logits = lambda x: [sum(v * weight((f, k)) for f, v in x.items()) for k in names]

    def shares(x, heat=1.0):
        e = [math.exp(v / heat - max(x) / heat) for v in x]
        return [v / sum(e) for v in e]

    for _ in range(language_id.PASSES):
        for place, i in enumerate(taught):
            if place % step != step - 1:
                x = value(i)
                p = shares(logits(x))
                w = {(f, k): weight((f, k)) for f in x for k in names}
                for k, share in zip(names, p):
                    for f, v in x.items():
                        g = v * (share - (rows[i][2] == k))
                        z[f, k] += g - (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / language_id.ALPHA * w[f, k]
                        n[f, k] += g * g
    tested = [i for place, i in enumerate(taught) if place % step == step - 1]
    loss = lambda heat: -sum(math.log(shares(logits(value(i)), heat)[names.index(rows[i][2])] + 1e-300) for i in tested)
    heat = min((2 ** (k / 200) for k in range(-800, 801)), key=loss)
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        x = logits(value(i))
        assert got[i].lang_pred == names[x.index(max(x))] and abs(got[i].score - max(shares(x, heat))) < 0.01
    assert sum(got[i].lang_pred == rows[i][2] for i in range(45, 60)) >= 14


def test_language_on_held_out_rows(spark):
    from cathlight.llm import queries
    from tests.oracle import DATA

    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = [r for r in queries.QUERIES["op13_language_id"](spark, "/root/testdata/sf0.01").collect()]
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and 100 < len(held) and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)
    assert queries.QUERIES["op13_language_id"](spark, DATA).count() == 200


def test_language_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.fit(none, F.lit(True)) is None
    rows = [(None, "abc", "l"), (1, None, "l"), (2, "x", None), (2, "x", None), (3, "w " * 50_000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("mine"), "lang_pred": F.lit(1), "_text": F.lit("mine")})
    assert {r.lang_pred for r in language_id.identified(docs, language_id.fit(docs, F.col("doc_id") == 2)).collect()} == {"und"}
    got = language_id.identified(docs, language_id.fit(docs, F.lit(True)))
    assert got.columns == ["doc_id", "text", "lang", "_text", "lang_pred", "score"] and sorted((r.doc_id or 0, r.lang_pred, r.score) for r in got.collect()) == [(0, "l", 1.0), (1, "und", 0.0), (2, "l", 1.0), (2, "l", 1.0), (3, "l", 1.0)]


class Clashing:
    """Names of 100 bytes that are all the same; the others as they are. Round 1 asks for pairs of them and length, so its stretches clash too, but for their anchors."""

    def __init__(self):
        self.whole = suffix_dedup.rank

    def __call__(self, short, p, length):
        return self.whole(short, p, length) & np.uint64(3 if length == 100 else M)


def test_repeats_survive_a_clash_of_names(spark, monkeypatch):
    rng = np.random.default_rng(6)
    passages = ["".join(rng.choice(list("abcdefgh "), 160)) for _ in range(6)]
    rows = [(i, " ".join(passages[(i + k) % 6] if (i + k) % 3 else "".join(rng.choice(list("abcdefgh "), 150)) for k in range(3))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "rank", Clashing())
    want = sorted(tuple(r) for r in suffix_dedup.suffix_dedup(docs, as_text=True).collect())
    seen, starts = set(), {}
    for i, t in sorted(rows):
        starts[i] = [p for p in range(len(t) - 99) if t[p : p + 100] in seen or seen.add(t[p : p + 100])]
    for i, t, n_bytes, n_removed, _, kept in want:
        gone = {x for p in starts[i] for x in range(p, p + 100)}
        assert kept == "".join(c for x, c in enumerate(t) if x not in gone) and n_removed == len(gone) and n_bytes == len(t)
    assert any(starts.values())


def test_second_names_tell_windows_apart():
    rng = np.random.default_rng(7)
    raw = rng.integers(0, 256, 5000, dtype=np.uint8)
    short = K.name32(np.concatenate([raw, np.zeros(32, np.uint8)]))
    p = np.arange(4900)
    assert len(np.unique(suffix_dedup.second_name(short, p, 100))) == 4900
    for at in (0, 31, 32, 63, 64, 95, 96, 99):  # every byte counts
        other = raw.copy()
        other[100 + at] ^= 1
        changed = K.name32(np.concatenate([other, np.zeros(32, np.uint8)]))
        assert suffix_dedup.second_name(short, np.array([100]), 100)[0] != suffix_dedup.second_name(changed, np.array([100]), 100)[0]


def test_queries_go_only_to_blocks_that_can_matter(spark, monkeypatch):
    edges = np.array([9.0, 5.0, 5.0, 1.0])
    got = topk_search.last_block(edges, np.array([1.0, 1.0, 1.0, 2.0, 0.0]), np.array([8.0, 5.0, -3.0, 2.0, 1.0]))
    assert got.tolist() == [0, 2, 3, 3, 0]
    monkeypatch.setattr(topk_search, "BLOCK", 16)
    monkeypatch.setattr(topk_search, "HEAD", 16)
    rng = np.random.default_rng(8)
    v = np.abs(rng.standard_normal((200, 6))) * (1.5 ** -np.arange(200)[:, None] * 50 + 0.02)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    w = np.floor(64 * v).astype(int)
    got = {}
    for r in topk_search.top_k(df, F.col("vec_id") % 5 == 0, k=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 200, 5):
        s = w @ w[q]
        assert got[q] == [(i, int(s[i])) for i in sorted((i for i in range(200) if i != q), key=lambda i: (-s[i], i))[:4]]
