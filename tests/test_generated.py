"""Text overlap and fuzzy matches against plain loops."""

import math
import random
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from cathlight.operators import fuzzy as Z
from cathlight.operators import generated as N

TEXTS = ["", " ", None, "a", "A b", "the cat sat on the mat", "the cat the cat on the mat", "on the mat sat the cat, the cat", "x y z w v", "a b c d", "a b c d e f g h", "a b c x d e f g", "b a d c", "the the the the", "word " * 300]


def plain_bleu(r, g):
    r, g = (r or "").lower().split(), (g or "").lower().split()
    logs = 0.0
    for n in range(1, 5):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (g, r))
        hits = sum(min(c, b[k]) for k, c in a.items())
        if n == 1 and not hits:
            return 0.0
        logs += math.log((hits or 0.1) / max(1, sum(a.values()))) / 4
    return math.exp(logs) * (1 if len(g) > len(r) else math.exp(1 - len(r) / len(g)))


def plain_rouge(r, g, n):
    import re

    r, g = ([w for w in re.split("[^a-z0-9]+", (x or "").lower()) if w] for x in (r, g))
    if n == "L":
        row = [0] * (len(g) + 1)
        for x in r:
            new = [0]
            for j, y in enumerate(g):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        hits, ours, theirs = row[-1], len(g), len(r)
    else:
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (g, r))
        hits, ours, theirs = sum(min(c, b[k]) for k, c in a.items()), sum(a.values()), sum(b.values())
    return 2 * hits / (ours + theirs) if ours + theirs else 0.0


def test_overlap_scores(spark):
    pairs = [(i * 100 + j, a, b) for i, a in enumerate(TEXTS) for j, b in enumerate(TEXTS)]
    df = spark.createDataFrame(pairs, "id long, r string, g string")
    scores = {r.id: r.bleu for r in N.bleu(df, "id", "r", "g").collect()}
    rouge = {r.id: r for r in N.rouge(df, "id", "r", "g").collect()}
    assert len(scores) == len(rouge) == len(pairs)
    for i, r, g in pairs:
        assert abs(scores[i] - plain_bleu(r, g)) < 1e-9, (r, g)
        for n, c in ((1, "rouge1"), (2, "rouge2"), ("L", "rougeL")):
            assert abs(rouge[i][c] - plain_rouge(r, g, n)) < 1e-9, (r, g, c)
    assert N.bleu(df.limit(0), "id", "r", "g").count() == 0 and N.rouge(df.limit(0), "id", "r", "g").count() == 0


def test_longest_common_subsequence(spark):
    rng = random.Random(4)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(90))], [rng.choice("abcd") for _ in range(rng.randrange(90))]) for _ in range(60)]
    for a, b, n in spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", N.common_words("a", "b")).collect():
        assert n == round(plain_rouge(" ".join(a), " ".join(b), "L") * (len(a) + len(b)) / 2)


def test_terms(spark):
    got = N.term_coverage(spark.createDataFrame([(1, "LAD stenosis and RCA", "lad seen"), (2, None, "x"), (3, "rca", None)], "id long, r string, g string"), "id", "r", "g", ["stenosis", "LAD", "RCA"]).collect()
    assert {tuple(r) for r in got} == {(1, 3, 1, 1 / 3), (2, 0, 0, 0.0), (3, 1, 0, 0.0)}


def test_fuzzy_matches_equal_all_pairs(spark):
    rng = random.Random(5)
    known = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(1, 30))) for _ in range(150)] + ["is there a stent", "", "a", "ab"]
    texts = [None, "", "zzz"]
    for t in known:
        x = list(t)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randrange(2)] = rng.choice(["", "q", "a", "bc"])
        texts.append("".join(x))
    left = spark.createDataFrame([(t,) for t in texts + texts[:5]], "t string")
    right = spark.createDataFrame(list(enumerate(known)), "o long, k string")
    for least in (0.6, 0.7, 0.85, 0.95):
        got = {r.t: r for r in Z.closest_templates(left, "t", right, "k", "o", least).collect()}
        assert set(got) == {t for t in texts if t is not None}
        for t, r in got.items():
            scores = [SequenceMatcher(None, t, k).ratio() for k in known]
            best = max(range(len(known)), key=lambda i: (scores[i], -i))
            want = ("exact", t, 1.0) if t in known else ("fuzzy", known[best], scores[best]) if scores[best] >= least else ("none", None, None)
            assert (r.strategy, r.match, r.score) == want, (t, least)


def test_options_by_rule(spark):
    left = spark.createDataFrame([("which vessel is it",), ("is it bad",), ("the stent, yes?",), ("hm",)], "t string")
    right = spark.createDataFrame([(0, "the stent, yes", ["yes", "no"])], "o long, k string, options array<string>")
    vessels, sure = F.array(F.lit("LAD"), F.lit("RCA")), F.array(F.lit("yes"), F.lit("no"), F.lit("unclear"))
    got = Z.options_for(left, "t", right, "k", "o", "options", 0.8, [("vessel", F.col("t").contains("vessel"), vessels), ("yes_no", F.col("t").startswith("is "), sure)], ("other", sure)).collect()
    assert {(r.t, r.strategy, len(r.options)) for r in got} == {("which vessel is it", "vessel", 2), ("is it bad", "yes_no", 3), ("the stent, yes?", "fuzzy", 2), ("hm", "other", 3)}


def test_fuzzy_part_names_equal_all_pairs(spark):
    from cathlight.plans import measures
    from tests.oracle import DATA

    texts, templates = measures.part_texts(spark, DATA)
    known = [r.template for r in templates.orderBy("p_partkey").collect()]
    got = measures.fuzzy_part_names(spark, DATA).collect()
    assert len(got) == texts.distinct().count() and len({r.strategy for r in got}) == 3 and sum(r.candidates for r in got) < len(got) * len(known) / 2
    for r in got:
        scores = [SequenceMatcher(None, r.text, k).ratio() for k in known]
        best = max(range(len(known)), key=lambda i: (scores[i], -i))
        assert (r.match, r.score) == ((known[best], scores[best]) if scores[best] >= 0.8 else (None, None))


def test_few_part_names_are_compared_in_full(spark):
    from cathlight.plans import measures
    from tests.oracle import DATA

    got = measures.fuzzy_part_names(spark, DATA).collect()
    assert sum(r.candidates for r in got) < 10 * len(got)


def test_fuzzy_matches_of_long_texts_in_many_blocks(spark, monkeypatch):
    rng = random.Random(8)
    known = ["".join(rng.choice("abcdefghij é") for _ in range(n)) for n in (1, 5, 40, 63, 64, 65, 66, 120, 255, 256, 257, 300, 20, 20, 20)]
    known += ["ab" * 30, "ba" * 30, "ab" * 150, "ba" * 150]
    texts = []
    for t in known:
        for changes in (1, len(t) // 12, len(t) // 6):
            x = list(t)
            for _ in range(changes):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randrange(2)] = rng.choice(["", "q", "a", "bc", "\U0001f600"])
            texts.append("".join(x))
    left = spark.createDataFrame([(t,) for t in texts], "t string")
    right = spark.createDataFrame([(-i / 2, k) for i, k in enumerate(known)], "o double, k string")  # the last of equals comes first
    for block in (4, 4096):
        monkeypatch.setattr(Z, "BLOCK", block)
        got = {r.t: r for r in Z.closest_templates(left, "t", right, "k", "o", 0.7).collect()}
        assert set(got) == set(texts)
        for t, r in got.items():
            scores = [SequenceMatcher(None, t, k).ratio() for k in known]
            best = max(range(len(known)), key=lambda i: (scores[i], i))
            want = (t, 1.0) if t in known else (known[best], scores[best]) if scores[best] >= 0.7 else (None, None)
            assert (r.match, r.score) == want, t


def test_common_length(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abc") for _ in range(n)) for n in (1, 2, 7, 30, 63, 64, 65, 90)]
    block = Z.Templates(words, list(range(len(words))))
    for a in ["", "zz", *words]:
        want = []
        for b in words:
            row = [0] * (len(b) + 1)
            for x in a:
                new = [0]
                for j, y in enumerate(b):
                    new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
                row = new
            want.append(row[-1])
        assert [Z.common_length(a, b) for b in words] == want == list(block.common(a, block.sizes.argsort(kind="stable")[: len(words)]))
