"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from cathlight.llm import kernels as K
from cathlight.llm import chat_format, near_dedup, packing, pieces, quality_rules, suffix_dedup, suffix_tree_lm, topk_search, toxicity, url_filter

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
ROWS = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (4, " \n "), (5, LONG), (6, LONG), (None, "a b c d e f g"), (7, None), (8, "x"), (9, "é" * 300 + "\n\n日本")]
EXTRA = ["_id", "n_shingles", "component_id", "kept", "score", "n_bytes", "kept_bytes", "n_words", "n_tokens", "ids", "decoded", "host", "_text", "sequence_id"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def clashing(df, *names):
    return df.withColumns({c: F.lit("mine") for c in EXTRA if c in names})


def test_near_duplicates(spark, docs):
    got = near_dedup.near_duplicates(clashing(docs, "n_shingles", "component_id", "kept"))
    rows = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()}
    assert got.count() == len(ROWS) and rows[1] == (3, 1, True) and rows[2] == rows[3][:0] + (0, 2, True) and rows[6][1:] == (5, False) and rows[5][1:] == (5, True)
    assert rows[None] == (None, None, None) and rows[8] == (1, 8, True)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """A chain of near copies, a dense group and unrelated texts that share a passage."""
    base = [f"u{i}" for i in range(100)]
    rows = [(k, " ".join(base[:k] + [f"v{k}"] + base[k + 1 :])) for k in range(60)]
    rows += [(1000 + k, " ".join([*base[:20], *(f"p{k}q{j}" for j in range(40))])) for k in range(60)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[k] for k in range(60)} == {0} and all(got[1000 + k] == 1000 + k for k in range(60))


def test_near_duplicates_in_nodes_that_branch(spark, monkeypatch):
    """Against all pairs: texts that share half or two thirds of their words, pairs of them near the threshold, and a group of near copies among them."""
    from tests.llm.test_queries import classes

    monkeypatch.setattr(near_dedup, "MIDDLE", 24)
    monkeypatch.setattr(near_dedup, "LEAF", 2)
    monkeypatch.setattr(near_dedup, "SAMPLE", 16)
    rng, rows = np.random.default_rng(3), []
    for part, shared in ((0, 60), (1, 110)):
        passage = [f"p{part}x{i}" for i in range(shared)]
        for k in range(300):
            own = [f"d{part}k{k}w{i}" for i in range(60)]
            rows.append((1000 * part + 2 * k, " ".join(passage + own)))
            if k % 3 == 0:  # a near copy with some of its last words changed
                n = int(rng.integers(4, 26))
                rows.append((1000 * part + 2 * k + 1, " ".join(passage + own[:-n] + [f"d{part}k{k}y{i}" for i in range(n)])))
        rows += [(5000 + 1000 * part + k, " ".join(passage + [f"c{part}w{i}" for i in range(40) if i != k % 40] + [f"z{k}"])) for k in range(120)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == classes(dict(rows), 1)


def test_near_duplicates_beyond_the_filter(spark, docs, monkeypatch):
    want = sorted(map(str, near_dedup.near_duplicates(docs).collect()))
    monkeypatch.setattr(near_dedup, "ACTIVE", 0)
    assert sorted(map(str, near_dedup.near_duplicates(docs).collect())) == want


def test_suffix_dedup(spark, docs):
    got = suffix_dedup.suffix_dedup(clashing(docs, "n_bytes", "kept_bytes"))
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(ROWS) and rows[6].n_removed == rows[6].n_bytes == len(LONG) and rows[2].n_bytes == 0 and rows[1].n_removed == 0
    assert rows[9].n_removed > 0 and suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0
    cut = {r.doc_id: r.kept_text for r in suffix_dedup.suffix_dedup(docs, as_text=True).collect()}
    assert "日本" in cut[9] and cut[6] == ""


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = toxicity.scored(clashing(docs, "score"), toxicity.fit(docs, labels))
    assert got.count() == len(ROWS) and got.where("score between 0 and 1").count() == len(ROWS)
    none = toxicity.scored(docs, toxicity.fit(docs, labels.limit(0)))
    assert {r.score for r in none.collect()} == {0.5}
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_toxicity_learns(spark):
    rows = [(i, f"word{i % 13} thing{i % 7} " + ("nasty" if i % 4 == 0 else "nice") + f" end{i % 5}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    got = toxicity.scored(docs, toxicity.fit(docs, labels.where("doc_id < 300"))).where("doc_id >= 300").collect()
    assert all((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in got)


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 0), (5, 1), (3, None)], "doc_id long, quality int")
    rules = quality_rules.learned_rules(docs, labels)
    got = quality_rules.judge_quality(clashing(docs, "kept", "n_words"), rules)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(ROWS) and rows[2].n_words == 0 and rows[2].base_failed and rows[5].n_words == 30_000
    assert quality_rules.learned_rules(docs, labels.limit(0)) == [] and quality_rules.judge_quality(docs.limit(0), []).count() == 0


def test_decision_list():
    rows = [{"a": i % 10, "b": i % 7, "bad": int(i % 10 >= 7 and i % 7 <= 2)} for i in range(700)]
    rules = quality_rules.learn(rows, ["a", "b"])
    assert all(any(quality_rules.holds(x, r) for r in rules) == bool(x["bad"]) for x in rows)


def test_language_model(spark, docs):
    got = suffix_tree_lm.score_texts(clashing(docs, "score", "n_tokens"), F.lit(True))
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(ROWS) and rows[2].n_tokens == 1 and rows[2].score == rows[3].score < 0
    empty = suffix_tree_lm.score_texts(docs, F.lit(False)).collect()
    assert {r.train_tokens for r in empty} == {0} and all(r.base_score == 0 for r in empty)
    assert suffix_tree_lm.score_texts(docs.limit(0), F.lit(True)).count() == 0


def test_tree_sums_to_one():
    """From any history, the probabilities of the 256 next bytes sum to 1."""
    from cathlight.llm import kernels as K

    key, _ = suffix_tree_lm.keys(*suffix_tree_lm.stream(K.Words(K.Texts(pa.array(["the cat sat on the mat " * 40, "a dog"], pa.large_string())))))
    grams, counts = [], []
    for depth in range(suffix_tree_lm.DEPTH + 1):
        k, n = np.unique(suffix_tree_lm.at_depth(key, depth), return_counts=True)
        grams.append(k)
        counts.append(n.astype(float))
    tree = suffix_tree_lm.Tree(len(key), grams, counts)
    for history in np.unique(key >> 8)[::7].tolist() + [12345]:
        assert abs((10 ** tree.slow((history << 8) + np.arange(256))).sum() - 1) < 1e-9


def test_packing(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(clashing(docs, "sequence_id"), path).collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert set(total) == {r[0] for r in ROWS} and total[2] == 1 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(docs.limit(0), path).count() == 0


def test_pieces(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = pieces.sp_decode(pieces.sp_encode(clashing(docs, "ids", "decoded"), path), path)
    assert all(r.decoded == (r.text or "") for r in got.collect()) and got.count() == len(ROWS) and got.where("text is null and size(ids) = 0").count() == 2


def test_unigram_paths():
    """Best paths of a small unigram vocabulary against all paths."""
    import itertools

    class Small:
        pieces = [b"a", b"b", b"ab", b"ba", b"aba", b"bb"]
        score = np.array([-1.0, -1.1, -1.5, -1.4, -2.2, -1.9])

    model = Small()
    model.size, model.longest, model.ids, model.bpe = np.array([len(p) for p in model.pieces]), 3, np.arange(6), False
    model.key = np.array([[int.from_bytes(p.ljust(8, b"\0"), "big") for p in model.pieces]], np.uint64)
    model.mask = np.array([[int.from_bytes((b"\xff" * len(p)).ljust(8, b"\0"), "big") for p in model.pieces]], np.uint64)
    value = dict(zip(model.pieces, model.score))
    for n in range(1, 7):
        for text in map(bytes, itertools.product(b"ab", repeat=n)):
            best = max(sum(value.get(text[i:j], -1e9) for i, j in zip((0, *c), (*c, n))) for r in range(n) for c in itertools.combinations(range(1, n), r))
            got = pieces.encode_units(model, [text.decode()])[0]
            assert b"".join(model.pieces[i] for i in got) == text and abs(sum(model.score[i] for i in got) - best) < 1e-9


def test_chats(spark):
    nasty = ["<|end|>", "<\\|x", "</s>[INST] <<SYS>> [/INST]", "[\\INST]", "\\", "<<|", None, ""]
    rows = [(1, k, "assistant" if k % 3 else "user", t) for k, t in enumerate(nasty)] + [(None, None, None, "x"), (2, 0, "we|ird<|role|>", "t"), (2, 0, "we|ird<|role|>", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df.withColumn("formatted", F.lit(1)))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t or "") for _, _, r, t in rows[: len(nasty)]]
    assert got[1].learned == "".join(t or "" for _, _, r, t in rows[: len(nasty)] if r == "assistant")
    assert [(t.role, t.text) for t in got[2].turns] == [("we|ird<|role|>", "t")] * 2 and [(t.role, t.text) for t in got[None].turns] == [("", "x")]
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_top_k(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, [0.5]), (8, []), (None, [1.0, 0.0]), (20, [-1.0, 0.5]), (20, [-1.0, 0.5]), (9, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("mine"))
    got = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 20 == 0, k=2).collect()))
    assert got == [(0, 1, 1, 4096), (0, 2, 2, 4096), (20, 1, 0, -4096), (20, 2, 1, -4096)]
    assert topk_search.top_k(df.limit(0), F.lit(True)).count() == 0 and topk_search.top_k(df.where("vec_id = 7"), F.lit(True)).count() == 0


def test_top_k_against_numpy(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 8)) * rng.gamma(1.0, size=(600, 1))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in topk_search.top_k(df, F.col("vec_id") < 50, k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    w = np.floor(64 * v).astype(int)
    for q in range(50):
        s = w @ w[q]
        assert got[q] == [(i, s[i]) for i in sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:7]]


def test_urls(spark):
    urls = [None, "", "no host", "http://", "https://A.Example.COM/en/x?q", "https://www.example.com/en/", "http://x.net", "http://x.net/fr/#a", "ftp://b.org?x/y", "http://b.org/p"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("mine"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[5] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[6] == ("x.net", "", None, "allow") and got[7] == ("x.net", "/fr/", "net/fr/", "block") and got[8] == ("b.org", "", None, "allow")
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_reputation_blocks_a_bad_host(spark):
    rows = [(f"http://{'bad' if i % 5 == 0 else f'h{i % 9}'}.org/{i}", int(i % 5 == 0 or i % 37 == 1)) for i in range(500)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "url string, y int"), bad=F.col("y")).select("host", "verdict").distinct().collect()
    assert {r.host for r in got if r.verdict == "block"} == {"bad.org"}


def test_tree_grows_with_the_input(spark, monkeypatch):
    """A context that is a small part of a large stream keeps its next bytes, and all values are those of one tree of all counts."""
    from cathlight.llm import kernels as K

    rows = [(i, "the cat sat on the mat and the dog ran " * 2000) for i in range(20)] + [(100, "zqxjkv " * 3), (101, "zqxjkw"), (200, "zqxjkv zqxjkv"), (201, "the zqxjkw é"), (202, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key_of = lambda texts: suffix_tree_lm.keys(*suffix_tree_lm.stream(K.Words(K.Texts(pa.array(texts, pa.large_string())))))[0]
    learned = key_of([t for i, t in rows if i < 200])
    tree = suffix_tree_lm.Tree(len(learned), *zip(*(np.unique(suffix_tree_lm.at_depth(learned, d), return_counts=True) for d in range(suffix_tree_lm.DEPTH + 1))))
    want = {i: tree.slow(key_of([t or ""])).sum() for i, t in rows}
    for known in (1 << 21, 3, 0):
        monkeypatch.setattr(suffix_tree_lm, "KNOWN", known, raising=False)
        got = {r.doc_id: r.score for r in suffix_tree_lm.score_texts(docs, F.col("doc_id") < 200).collect()}
        assert got[200] > -25 and all(abs(got[i] - want[i]) < 1e-6 * abs(want[i]) for i in want)


def test_near_duplicate_trees_branch():
    """The roots of the trees have no coordinate in common, and a node's children come from BRANCH different ones, the most distinct ones if told."""
    n = near_dedup.COORDS
    coords = np.tile(np.arange(n, dtype=np.uint32), (n + 1, 1))
    coords[np.arange(n), np.arange(n)] = 999  # class i differs from the last one at coordinate i only
    binary = pa.array([c.tobytes() for c in coords], pa.binary())
    rows = next(near_dedup.plant(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), binary], names=["_id", "_coords"])]))).to_pydict()
    own = {x for x, i in zip(rows["node"], rows["_id"]) if i == n}
    alone = [i for i in range(n) if len(own & {x for x, j in zip(rows["node"], rows["_id"]) if j == i}) < 2 * near_dedup.TREES]
    assert len(own) == 2 * near_dedup.TREES and alone == list(range(2 * near_dedup.TREES))
    table = {"node": np.full(n + 1, 12345), "_id": np.arange(n + 1), "component": np.arange(n + 1), "n_shingles": np.full(n + 1, 60)}
    table = {**{k: pa.array(v) for k, v in table.items()}, "_coords": binary}
    picks = near_dedup.choose(pa.table(table)).column("picks")[0].as_py()
    assert len(set(picks)) == near_dedup.BRANCH
    batch = pa.RecordBatch.from_arrays([*table.values(), pa.array([picks] * (n + 1), pa.binary())], names=[*table, "picks"])
    rows = pa.Table.from_batches(near_dedup.branch(iter([batch])))
    size = {i: 0 for i in range(n)}
    last = {x for x, i in zip(rows.column("node").to_pylist(), rows.column("_id").to_pylist()) if i == n}
    for x, i in zip(rows.column("node").to_pylist(), rows.column("_id").to_pylist()):
        if i < n:
            size[i] += x in last
    assert len(last) == near_dedup.BRANCH and sorted(i for i in size if size[i] < near_dedup.BRANCH) == sorted(picks)

def test_packing_scores_all_terms():
    """A seed whose 40 rarest tokens are its own alone still finds the tail that shares its other tokens."""
    tails = [np.arange(50), np.arange(100, 150), np.arange(40, 60), np.arange(200, 230)]
    shard = packing.Shard(tails, corpus_of(tails))
    shard.unused[0] = False
    assert shard.retrieve(tails[0]).tolist() == [2]


def corpus_of(tails):
    df = np.bincount(np.concatenate([np.unique(t) for t in tails]), minlength=int(max(map(max, tails))) + 1)
    return packing.Corpus(len(tails), sum(map(len, tails)), df)


def test_packing_retrieves_as_plain_bm25():
    import math

    rng = np.random.default_rng(5)
    tails = [np.minimum(rng.zipf(1.3, int(rng.integers(1, 60))), 400) for _ in range(80)]
    shard, n, mean = packing.Shard(tails[:50], corpus_of(tails)), len(tails), sum(map(len, tails)) / len(tails)
    df = {t: sum(t in x for x in map(set, (y.tolist() for y in tails))) for t in range(401)}
    for q in range(50):
        score = []
        for x in (y.tolist() for y in tails[:50]):
            idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in set(tails[q].tolist())}
            score.append(sum(idf[t] * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in idf))
        got = shard.retrieve(tails[q])
        assert set(got.tolist()) == {i for i, s in enumerate(score) if s > 0}
        assert all(score[a] >= score[b] - 1e-9 for a, b in zip(got[:-1], got[1:]))


def test_packing_scores_alike_by_products_and_lists(monkeypatch):
    """Frequent tokens by products, rare ones by lists: every score is that of the plain sum, to the last digit, however the parts are cut."""
    rng = np.random.default_rng(8)
    tails = [np.minimum(rng.zipf(1.2, int(rng.integers(1, 300))), 3000) for _ in range(400)]
    corpus = corpus_of(tails)
    shard = packing.Shard(tails, corpus)
    assert len(shard.common) > 5 and (shard.column[1:] < 0).sum() > 100
    weight = np.zeros((len(corpus.idf), len(tails)))
    for i, t in enumerate(tails):
        k, tf = np.unique(t, return_counts=True)
        weight[k, i] = np.ceil(corpus.idf[k] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / corpus.mean)) * 2.0**36)
    monkeypatch.setattr(packing, "CELLS", 400 * 100)  # as in a shard so large that only some tails have their products ready
    few = packing.Shard(tails, corpus)
    assert len(shard.shared) == 400 and len(few.shared) == 100
    for i, t in enumerate(tails):
        want = weight[np.unique(t)].astype(np.int64).sum(axis=0) / 2.0**36
        assert all(np.array_equal(got, want) for got in (shard.score(t), shard.score(t, i), few.score(t, i)))
        assert shard.retrieve(t).tolist() == [k for k in np.argsort(-want, kind="stable").tolist() if want[k] > 0]


def test_packing_reads_few_weights_for_tokens_of_most_tails():
    """Scoring a shard of tails that share their words reads each seed's rare tokens alone."""
    rng = np.random.default_rng(9)
    tails = [np.concatenate([rng.permutation(200)[:150], 200 + rng.integers(0, 20000, 20)]) for _ in range(600)]
    shard = packing.Shard(tails, corpus_of(tails))
    assert len(shard.common) == 200 and max(np.diff(shard.first)[np.unique(t)].sum() for t in tails) < 100


def test_packing_encodes_parts_as_the_whole(monkeypatch):
    """Parts cut at spaces, ends of lines and signs give the library's ids, whatever stands beside them."""
    import random

    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "_memos", {})
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(10)
    signs = ["a", "é", "ñ", "×", "÷", "ª", "’", "'", "'s", "'re", '"', ",", "...", "-", "_", "<|endoftext|>", "<|", "|>", "1", "½", "日", "я", "😀", "\u0301", "\u200d", "\x00", "\x1c", "\x7f", "Ġ", "Ċ", "The", "word"]
    gaps = [*[" "] * 8, *["\n"] * 4, *[""] * 6, "\t", "\r", "\v", "\f", "\x85", "\xa0", "\u3000", "  ", "\r\n", "\n "]
    texts = ["".join(rng.choice(signs) + rng.choice(gaps) for _ in range(rng.randint(0, 20))).strip(" ") for _ in range(4000)]
    coder = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode(pa.array(texts, pa.large_string()), path)] == [x.ids for x in coder.encode_batch(texts, add_special_tokens=False)]


def test_packing_remembers_a_word_once_whatever_sign_follows(monkeypatch):
    monkeypatch.setattr(packing, "_memos", {})
    path = public_tokenizers.path("byte_bpe_50k.json")
    packing.encode(pa.array(["a wordé wordé, wordé. wordé; (wordé)\nwordé!"], pa.large_string()), path)
    assert packing._memos[path].n == len(["a", " wordé", ",", ".", ";", " (wordé", ")", "\n", "wordé", "!"])


def test_packing_routes_copies_side_by_side():
    rng = np.random.default_rng(6)
    tails = [rng.integers(1, 5000, 200) for _ in range(500)]
    copies = [np.concatenate([t[:190], rng.integers(1, 5000, 10)]) for t in tails]
    corpus = corpus_of(tails + copies)
    same = [corpus.route(a) == corpus.route(b) for a, b in zip(tails, copies)]
    assert np.mean(same) > 0.7


def test_top_k_of_large_components(spark):
    """Components beyond the exact range of doubles' products, with scores that differ in their last digits."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(60, 4)) * np.where(np.arange(60) % 3 == 0, 3e6, 1.0)[:, None]
    v[3], v[6] = [40000.0, 1, 0, 0], [2.0**23 + 1, 2.0**23, 1 / 64, 0]
    v[9] = v[6] + [0, 0, 1 / 64, 0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in topk_search.top_k(df, F.lit(True), k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    w = [[int(x) for x in row] for row in np.floor(64 * v)]
    for q in range(60):
        s = [sum(a * b for a, b in zip(w[q], c)) for c in w]
        assert got[q] == [(i, s[i]) for i in sorted((i for i in range(60) if i != q), key=lambda i: (-s[i], i))[:5]]


def test_words_that_share_a_hash(monkeypatch):
    """Remembered words are told apart by their bytes, in one batch and from batch to batch."""
    import sentencepiece
    from tokenizers import Tokenizer

    whole = K.Words.hashes
    monkeypatch.setattr(K.Words, "hashes", lambda self, most=0: whole(self, most) % np.uint64(97))
    monkeypatch.setattr(packing, "_memos", {})
    monkeypatch.setattr(pieces, "_memos", {})
    stem = "q" * 300
    batches = [["the cat sat on the mat", "", f"a {stem}a {stem}b x", "one", "the tree"], [" ".join(f"w{i} {i} é{i}" for i in range(400)), "the cat", f"z {stem}b {stem}c", "b  c"]]
    path, model = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    coder, library = Tokenizer.from_file(path), sentencepiece.SentencePieceProcessor(model_file=model)
    for texts in batches * 2:
        column = pa.array(texts, pa.large_string())
        assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode(column, path)] == [coder.encode(t, add_special_tokens=False).ids for t in texts]
        ids, cut = pieces.encode_column(model, column)
        assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])] == [library.encode(t) for t in texts]


@pytest.mark.parametrize("size", [1, 7, 8, 9, 16, 17, 255, 256, 257, 3000])
def test_differing_bytes_are_seen_at_every_place(size):
    word = b"a" * size
    words = [word] + [word[:i] + b"b" + word[i + 1 :] for i in sorted({0, size // 2, size - 1})] + [word + b"a", word]
    memo = K.Memo()
    number = memo.add(np.array([5], np.uint64), np.zeros(1, np.uint32), np.ones(1, np.int64), [word])
    found = K.Words(K.Texts(pa.array([b" ".join(words).decode()], pa.large_string())), lower=False)
    assert memo.differ(found, np.arange(len(words)), np.repeat(number, len(words))).tolist() == [w != word for w in words]
