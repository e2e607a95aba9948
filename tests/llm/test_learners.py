"""The learned scores against plain loops over dictionaries."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from cathlight.llm import quality_rules, suffix_tree_lm, toxicity
from tests.oracle import DATA


def test_ftrl_as_a_plain_loop():
    """Per-coordinate rates and L1 shrinkage, one coordinate at a time."""
    rng = np.random.default_rng(8)
    examples = [(int(rng.integers(0, 2)), np.unique(rng.integers(0, 300, int(rng.integers(1, 30)))).astype(np.int32)) for _ in range(200)]
    z, n, bias = defaultdict(float), defaultdict(float), 1 << toxicity.BITS

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for y, own in examples:
            w = {i: weight(i) for i in [*own.tolist(), bias]}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y
            for i, x in w.items():
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * x
                n[i] += g * g
    got = toxicity.train(examples)
    want = {i: weight(i) for i in list(z)}
    assert np.count_nonzero(got) == sum(x != 0 for x in want.values()) > 0
    assert all(abs(got[i] - x) < 1e-9 for i, x in want.items())


def test_kept_is_the_base_rules_and_the_decision_list(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rules = [*quality_rules.learned_rules(docs, labels), [("n_symbols", ">=", 30.5), ("n_words", "<=", 400.5)]]
    stats = {r["doc_id"]: r.asDict() for r in quality_rules.statistics(docs.select("doc_id", "text"), "text").collect()}
    for r in quality_rules.judge_quality(docs.select("doc_id", "text"), rules).collect():
        x = stats[r.doc_id]
        base = x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"]
        assert r.base_failed == base and r.kept == (not base and not any(quality_rules.holds(x, rule) for rule in rules))


def stream(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()]
    return b"".join(w.encode() + b" " for w in words) + b"\n"


def test_suffix_tree_as_plain_dictionaries(spark):
    """Counts of all contexts, the divergence test, states with their suffixes, and the longest state before every byte."""
    rng = np.random.default_rng(9)
    vocabulary = ["anna", "banana", "Bandana", "and", "sand", "stand", "é", "x1"]
    texts = {i: " ".join(rng.choice(vocabulary, int(rng.integers(0, 25)), p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05])) for i in range(120)}
    depth, prior = suffix_tree_lm.DEPTH, suffix_tree_lm.PRIOR
    counts = [defaultdict(Counter) for _ in range(depth + 1)]
    for i, t in texts.items():
        if i < 90:
            s = b"\n" * depth + stream(t)
            for k in range(depth, len(s)):
                for d in range(depth + 1):
                    counts[d][s[k - d : k]][s[k]] += 1

    def probability(context, c):
        below = probability(context[1:], c) if context else 1 / 256
        own = counts[len(context)][context]
        return (own[c] + prior * below) / (sum(own.values()) + prior)

    states = {x for d in (0, 1) for x in counts[d]}
    for d in range(2, depth + 1):
        for context, own in counts[d].items():
            gain = sum(n * math.log(probability(context, c) / probability(context[1:], c)) for c, n in own.items())
            if sum(own.values()) >= suffix_tree_lm.LEAST and gain >= suffix_tree_lm.GAIN:
                states |= {context[k:] for k in range(d)}

    def log(context, c):
        while context not in states:
            context = context[1:]
        out = 0.0
        while not counts[len(context)][context][c]:
            out += math.log10(prior / (sum(counts[len(context)][context].values()) + prior))
            if not context:
                return out + math.log10(1 / 256)
            context = context[1:]
        return out + math.log10(probability(context, c))

    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in suffix_tree_lm.score_texts(docs, F.col("doc_id") < 90).collect():
        s = b"\n" * depth + stream(texts[r.doc_id])
        want = sum(log(s[k - depth : k], s[k]) for k in range(depth, len(s)))
        assert abs(r.score - want) < 1e-6 * max(1.0, abs(want)), r.doc_id
