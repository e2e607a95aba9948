"""Importance resampling and conversation repair against plain loops, and their odd rows."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from cathlight.llm import conversation_repair, resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n):
    w = [x.translate(LOWER) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain_resample(docs, target, n, buckets, percent, least, seed):
    s, t = (Counter(zlib.crc32(f.encode()) % buckets for x in texts for f in features(x, n)[1]) for texts in ([t for _, t in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    out = []
    for i, text in docs:
        w, f = features(text, n)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(zlib.crc32(x.encode()) % buckets) for x in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    places = {id(r): k + 1 for k, r in enumerate(fit[: len(fit) * percent // 100])}
    return sorted(((*r[:4], places.get(id(r))) for r in out), key=str)


def test_resampling_with_pairs_of_words_and_odd_rows(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["Alpha", "beta2", "ÉTÉ", "gamma", "x" * 100, "d'or", "日本", f"rare{rng.randrange(999)}"]) for _ in range(rng.randrange(30)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, " \n.. "), (None, "alpha " * 25), (503, "alpha beta2 " * 20), (503, "alpha beta2 " * 20), (504, "beta2 " * 20_000)]
    target = ["alpha beta2 ÉTÉ", None, "", "beta2 gamma"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("mine"), "_words": F.lit(1), "feature": F.lit("f")})
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for n, buckets, percent in ((1, 50, 10), (2, 1000, 40), (3, 7, 100)):
        got = resampling.resample(df, goal, n=n, buckets=buckets, percent=percent, least_words=5, seed=9)
        assert got.columns == ["doc_id", "text", "_words", "feature", "n_features", "weight", "score", "rank"]
        assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == plain_resample(docs, target, n, buckets, percent, 5, 9)
    assert resampling.resample(df.limit(0), goal).count() == 0
    bare = resampling.resample(df, goal.limit(0), percent=100).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(r) for r in bare), key=str) == plain_resample(docs, [], 1, 10_000, 100, 20, 2024)


def test_resampling_without_a_frequent_feature(spark, monkeypatch):
    monkeypatch.setattr(resampling, "KNOWN", 3)
    docs = [(i, f"the cat number{i % 9} sat on mat {i} the end " * 3) for i in range(60)]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("cat mat",)], "text string"), carry=["doc_id"])
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_resample(docs, ["cat mat"], 1, 10_000, 10, 20, 2024)


def audits(rows):
    """(cost, audit) by Dijkstra over (cost, string): the first full one to be met is the cheapest, then the least."""
    again, kinds = set(), []
    for role, text in rows:
        seen, dropped = (role, text), not re.search(r"[^\x20\x09-\x0D]", text)
        cut = not dropped and re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) is None
        kinds.append((role[:1], dropped or seen in again, cut))
        again.add(seen)
    keep, insert = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}, (2, 2, 3, 2)
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, text, i, q = heapq.heappop(heap)
        if (text, i, q) in done:
            continue
        done.add((text, i, q))
        if i == len(rows) and q in (0, 3):
            return cost, text
        heapq.heappush(heap, (cost + 5, text + "I", i, insert[q]))
        if i < len(rows):
            role, must, cut = kinds[i]
            heapq.heappush(heap, (cost + 2, text + "D", i + 1, q))
            if not must:
                if (q, role) in keep:
                    heapq.heappush(heap, (cost + 5 * cut, text + "K", i + 1, keep[q, role]))
                for (a, r), to in keep.items():
                    if a == q and r != "s":
                        heapq.heappush(heap, (cost + 1 + 5 * cut, text + "R", i + 1, to))


def rebuilt(rows, audit):
    out, at, m = [], 0, sum(c != "D" for c in audit)
    for c in audit:
        role = ("system", "user", "assistant")[(0 if not out else 2 - len(out) % 2) if m % 2 else 1 + len(out) % 2]
        if c == "I":
            out.append((role, ""))
            continue
        if c != "D":
            out.append((rows[at][0] if c == "K" else role, rows[at][1]))
        at += 1
    return out


def test_repairs_are_the_cheapest_then_least(spark):
    rng, table, want = random.Random(2), [], {}
    for conv in range(150):
        n = rng.randrange(1, 7)
        rows = [(rng.choice(["user", "assistant", "system", "user", "tool", ""]), rng.choice(["a.", "b!", "c", " ", "d?", "e. "])) for _ in range(n)]
        table += [(conv, k, *r) for k, r in enumerate(rows)]
        want[conv] = rows
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    done = conversation_repair.Repaired(df.repartition(5))
    found = {}
    for r in done.rows.orderBy("conv_id", "place").collect():
        found.setdefault(r.conv_id, []).append((r.role, r.text))
    report = {r.conv_id: r for r in done.report.collect()}
    assert set(report) == set(want)
    for conv, rows in want.items():
        cost, audit = audits(rows)
        assert (report[conv].cost, report[conv].audit) == (cost, audit), rows
        assert found.get(conv, []) == rebuilt(rows, audit)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in found.get(conv, [])))
    for r in done.digests.collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in found.get(r.conv_id, [])).encode()).hexdigest()


def test_repair_of_odd_rows(spark):
    rows = [(1, None, "user", "a."), (1, 3, "assistant", "b."), (1, 7, None, None), (None, 1, "user", "x."), (None, 2, "assistant", "y."), (2, 0, "user", "t " * 100_000 + "."), (2, 1, "assistant", "z."), (3, 5, "system", "s.")]
    rows += [(4, k, "user", "same.") for k in range(300)] + [(5, 9, "user", "q?"), (5, 9, "user", "q?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"cost": F.lit("mine"), "_c": F.lit(1), "audit": F.lit("x"), "here": F.lit(False)})
    got = {r.conv_id: r for r in conversation_repair.Repaired(df).digests.collect()}
    assert (got[1].audit, got[1].blank, got[1].gaps, got[1].illegal, got[1].cost) == ("KKD", 1, 3, 1, 2) and got[None].audit == "KK" and got[2].audit == "KK" and got[3].audit == "D"
    assert got[4].duplicate == 299 and got[4].audit == "D" * 300 and got[4].cost == 600 and (got[5].duplicate, got[5].illegal, got[5].audit) == (1, 1, "DD")
    assert got[2].repaired_sha256 == hashlib.sha256(("user:" + "t " * 100_000 + ".\nassistant:z.").encode()).hexdigest()
    none = conversation_repair.Repaired(df, here=F.lit(False)).digests.collect()
    assert len(none) == 6 and all((r.cost, r.audit, r.gaps, r.repaired_sha256) == (0, "", 0, hashlib.sha256(b"").hexdigest()) for r in none)
    empty = conversation_repair.Repaired(df.limit(0))
    assert empty.digests.count() == 0 and empty.rows.count() == 0


def test_the_automaton_stays_small():
    machine = conversation_repair.Automaton()
    for kinds in itertools.product(range(9), repeat=4):
        machine.repair(bytes(kinds))
    n = len(machine.vectors)
    rng = random.Random(3)
    for _ in range(200):
        machine.repair(bytes(rng.randrange(9) for _ in range(200)))
    assert n <= len(machine.vectors) < 200 and len(machine.steps) <= 9 * len(machine.vectors)
