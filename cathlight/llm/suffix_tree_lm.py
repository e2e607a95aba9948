"""Language-model scores by a probabilistic suffix tree (operator 8).

Texts are lower-cased (A-Z) and read as words, each followed by a space, and one end. The tree
predicts that stream byte by byte, so every text has a probability, whatever its words. A state is
the last 0 to DEPTH bytes. Contexts of at most one byte are states; a longer one becomes a state if
it was met LEAST times, whatever the size of the stream, and its next-symbol distribution diverges from that of its suffix (the count times
the Kullback-Leibler divergence is at least GAIN nats), or if a longer state needs it. A state keeps
all its next-symbol counts. Its distribution is smoothed with that of its suffix, down to the uniform
one, and a text is scored by the longest state that ends its history at each byte.

The stream's counts are those of all training texts, and the tree grows with them, so it is never
held in one place: all histories that end in the same two bytes are one group, which has every count
of the depths from two on; the two depths above are at most 65,792 entries, and go to each group. A
group tells the probability of each of its keys (history and next byte) that any text has. The KNOWN
most frequent keys are broadcast with it, all others are joined by hash. Word counts, which the base
score needs, go the same way: words with at least 1 / SHARE of all tokens (at most SHARE words) are
broadcast, all others are joined.

Null and empty texts are one end. Rows with a null id are not learned from and are scored like others.
Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, table

DEPTH, LEAST, GAIN, PRIOR = 6, 2, 10.0, 12.0
SHARE, KNOWN = 1 << 20, 1 << 21
END, GAP = 10, 32
SLOT = 1 << 21
SLICE = 1 << 19  # bytes of text at a time; some 130 bytes of arrays for each


def stream(words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the tree predicts, DEPTH ends before each text, and where texts begin (one more than texts)."""
    size = words.end - words.begin + 1
    docs = len(words.count)
    per = np.bincount(words.doc, size, docs).astype(np.int64) + DEPTH + 1
    start = np.concatenate([[0], np.cumsum(per)])
    out = np.full(start[-1], END, np.uint8)
    if len(size):
        total = np.cumsum(size)
        at = total - size + DEPTH + words.doc * (DEPTH + 1)
        n = int(total[-1])
        step = np.arange(n) - np.repeat(total - size, size)
        source = np.minimum(np.repeat(words.begin, size) + step, len(words.bytes) - 1)
        out[np.repeat(at, size) + step] = words.bytes[source]
        out[at + size - 1] = GAP
    return out, start


def keys(raw: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each predicted byte with the DEPTH bytes before it, and where texts begin in them.

    A key is the history, its last byte first, then the predicted byte: suffixes of a history are
    prefixes of its key, so sorted keys meet the states of every depth in order.
    """
    v = K.loads(np.concatenate([raw, np.zeros(8, np.uint8)]))[: max(len(raw) - DEPTH, 0)]
    out = ((v & np.uint64((1 << 8 * DEPTH) - 1)) << np.uint64(8) | (v >> np.uint64(8 * DEPTH)) & np.uint64(255)).view(np.int64)
    inner = np.ones(len(out), bool)
    for s in range(DEPTH):  # the ends before a text aren't predicted
        inner[start[1:-1] - DEPTH + s] = False
    return out[inner], start - np.arange(len(start)) * DEPTH


def at_depth(key, depth: int):
    """The key of a shorter history."""
    return key >> 8 * (1 + DEPTH - depth) << 8 | key & 255


class Tree:
    """States and distributions of each depth as sorted arrays."""

    def __init__(self, total: int, grams: list[np.ndarray], counts: list[np.ndarray]):
        """Of each depth, its keys (context and next byte) with their counts, sorted; total: the stream's length."""
        self.levels: list[tuple] = []  # contexts, log10 of the weight left for the suffix, entries, their log10 probability
        uniform = np.full(256, 1 / 256)
        tables = []
        for key, n in zip(grams, counts):
            context, group = np.unique(key >> 8, return_inverse=True)
            tables.append((key, n, context, group, np.bincount(group, n, len(context)) if len(key) else np.zeros(0)))
        # probabilities top down, as if all contexts were states
        probability, keep = [], []
        for depth, (key, n, context, group, size) in enumerate(tables):
            if depth == 0:
                below = uniform[key & 255]
            else:
                below = probability[-1][np.searchsorted(tables[depth - 1][0], key >> 16 << 8 | key & 255)]
            p = (n + PRIOR * below) / (size[group] + PRIOR)
            gain = np.bincount(group, n * np.log(p / below), len(context)) if len(key) else np.zeros(0)
            probability.append(p)
            keep.append((size >= LEAST) & (gain >= GAIN) if depth > 1 else np.ones(len(context), bool))
        for depth in range(DEPTH, 1, -1):  # a state's suffixes are states
            need = np.unique(tables[depth][2][keep[depth]] >> 8)
            keep[depth - 1][np.searchsorted(tables[depth - 1][2], need)] = True
        for depth, (key, n, context, group, size) in enumerate(tables):
            own = keep[depth]
            some = own[group] if len(key) else np.zeros(0, bool)
            self.levels.append((context[own], np.log10(PRIOR / (size[own] + PRIOR)), key[some], np.log10(probability[depth][some])))

    def slow(self, key: np.ndarray) -> np.ndarray:
        """log10 P(last byte | longest state before it)."""
        out, open_ = np.zeros(len(key)), np.ones(len(key), bool)
        for depth in range(DEPTH, -1, -1):
            context, weight, entry, value = self.levels[depth]
            own = at_depth(key, depth)
            if not len(context):
                continue
            at = np.minimum(np.searchsorted(context, own >> 8), len(context) - 1)
            here = open_ & (context[at] == own >> 8)
            e = np.minimum(np.searchsorted(entry, own), len(entry) - 1)
            hit = here & (entry[e] == own)
            out[hit] += value[e[hit]]
            open_ &= ~hit
            miss = here & ~hit
            out[miss] += weight[at[miss]]
        out[open_] += np.log10(1 / 256)
        return out


class Known:
    """Values of frequent keys; the most frequent ones are found by a table, the others by search."""

    def __init__(self, key: np.ndarray, value: np.ndarray, n: np.ndarray):
        order = np.argsort(key)
        self.key, self.value = key[order], value[order]
        self.slot = np.zeros(SLOT, np.int32)
        by = np.argsort(n[order], kind="stable")
        self.slot[self.place(self.key[by])] = by  # by rising count

    @staticmethod
    def place(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * K.MULT[0] >> np.uint64(64 - SLOT.bit_length() + 1)).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's value, 0 if it isn't known, and whether it is."""
        if not len(self.key):
            return np.zeros(len(key)), np.zeros(len(key), bool)
        at = self.slot[self.place(key)].astype(np.int64)
        miss = np.flatnonzero(self.key[at] != key)
        at[miss] = np.minimum(np.searchsorted(self.key, key[miss]), len(self.key) - 1)
        hit = self.key[at] == key
        return np.where(hit, self.value[at], 0.0), hit


def group_values(top: list[tuple[np.ndarray, np.ndarray]]):
    """(k, n, value) of the keys of one group, n their counts in training, from the counts of depths 0 and 1."""

    def run(rows: pa.Table) -> pa.Table:
        k, n = rows.column("k").to_numpy(), rows.column("n").to_numpy()
        order = np.argsort(k)
        k, n = k[order], n[order]
        own = top[1][0] >> 8 == int(k[0]) >> 8 * DEPTH
        grams, counts = [top[0][0], top[1][0][own]], [top[0][1], top[1][1][own]]
        seen, times = k[n > 0], n[n > 0]
        for depth in range(2, DEPTH + 1):
            key, inverse = np.unique(at_depth(seen, depth), return_inverse=True)
            grams.append(key)
            counts.append(np.bincount(inverse, times, len(key)))
        tree = Tree(int(times.sum()), grams, counts)
        return pa.table([pa.array(k), pa.array(n), pa.array(tree.slow(k))], names=["k", "n", "value"])

    return run


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 7


def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    """The rows to learn from (1) and the others (0), 1000 at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            yield part.filter(part.column("_learn")), 1
            yield part.filter(pc.invert(part.column("_learn"))), 0


def score_texts(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score; training says which rows to learn from.

    Columns of docs that clash with these names are replaced.
    """
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    text = F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    learned = F.coalesce(training, F.lit(False)).alias("_learn")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: words by hash; 1: stream keys, those of texts that aren't learned from with no count; 2: ends. Each task sums what it meets."""
        K.release()
        ends, held = 0, {0: [], 1: []}

        def merge(kind: int) -> None:
            k, n = (np.concatenate(x) for x in zip(*held[kind]))
            k, inverse = np.unique(k, return_inverse=True)
            held[kind] = [(k, np.bincount(inverse, n, len(k)).astype(np.int64))]

        for batch, learn in halves(batches):
            column = K.plain(batch, "_text")
            ends += learn * len(column)
            for i, j in K.slices(column, SLICE):
                words = K.Words(K.Texts(column[i:j]))
                key, _ = keys(*stream(words))
                for kind, found in ((0, words.hashes().view(np.int64)), (1, key)):
                    if not learn and not kind:
                        continue
                    k, n = np.unique(found, return_counts=True)
                    held[kind].append((k, n * learn))
                    if len(held[kind]) > 5:
                        merge(kind)
                    if len(held[kind]) == 1 and len(held[kind][0][0]) > 300_000:
                        k, n = held[kind].pop()
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n)], names=["kind", "k", "n"])
        for kind in (0, 1):
            if held[kind]:
                merge(kind)
                k, n = held[kind][0]
                for a in range(0, len(k), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[a : a + 100_000]), kind, np.int32)), pa.array(k[a : a + 100_000]), pa.array(n[a : a + 100_000])], names=["kind", "k", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([ends], pa.int64())], names=["kind", "k", "n"])

    counts = scratch.write(docs.select(text, learned).mapInArrow(count, "kind int, k long, n long").groupBy("kind", "k").agg(F.sum("n").alias("n")))
    totals = {r.kind: (r.n, r.v) for r in counts.where("n > 0").groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    ends = totals.get(2, (0, 0))[0]
    tokens, distinct = totals.get(0, (0, 0))[0] + ends, totals.get(0, (0, 0))[1] + (ends > 0)
    least = -(-tokens // SHARE)
    frequent = counts.where((F.col("kind") == 0) & (F.col("n") >= max(least, 2))).select("k", "n").toArrow()
    grams, top = counts.where("kind = 1").select("k", "n"), []
    for depth in (0, 1):
        own = F.shiftleft(F.shiftright("k", 8 * (1 + DEPTH - depth)), 8).bitwiseOR(F.col("k").bitwiseAND(255))
        got = grams.where("n > 0").groupBy(own.alias("k")).agg(F.sum("n").alias("n")).orderBy("k").toArrow()
        top.append((got.column("k").to_numpy(), got.column("n").to_numpy().astype(np.float64)))
    values = scratch.write(grams.groupBy(F.shiftright("k", 8 * (DEPTH - 1)).alias("g")).applyInArrow(group_values(top), "k long, n long, value double"))
    # the least count that at most KNOWN keys reach, to a sixteenth of a power of two
    step, room = F.floor(F.log2("n") * 16), KNOWN
    least = None
    for r in values.where("n > 0").groupBy(step.alias("x")).agg(F.count("*").alias("c")).orderBy(F.desc("x")).collect():
        room -= r.c
        if room < 0:
            break
        least = r.x
    top_keys = values.where((F.col("n") > 0) & (step >= least) if least is not None else F.lit(False)).toArrow()
    tree = Known(*(top_keys.column(c).to_numpy() for c in ("k", "value", "n")))
    order = np.argsort(frequent.column("k").to_numpy())
    shared = spark.sparkContext.broadcast((tree, frequent.column("k").to_numpy()[order], frequent.column("n").to_numpy()[order]))
    own = docs.drop(*added).withColumns({"_i": F.col(id_col).cast("long"), "_h": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        tree, known, times = shared.value
        logs = np.log10(times + 1.0)
        for batch in batches:
            column = K.plain(batch, "_text")
            for i, j in K.slices(column, SLICE):
                words = K.Words(K.Texts(column[i:j]))
                raw, start = stream(words)
                key, begin = keys(raw, start)
                value, told = tree.find(key)
                total = np.add.reduceat(value, begin[:-1])
                far = key[~told]
                ends = np.concatenate([[0], np.cumsum(~told)])[begin]
                h = words.hashes().view(np.int64)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                rare = h[~hit]
                cut = np.searchsorted(words.doc[~hit], np.arange(j - i + 1))
                parts = [rare[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
                others = [far[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_i"), part.column("_h"), pa.array(words.count + 1), pa.array(np.bincount(words.doc[hit], minlength=j - i).astype(np.int64)), pa.array(np.bincount(words.doc[hit], logs[at[hit]], j - i).astype(float)), pa.array(total), pa.array(parts, pa.binary()), pa.array(others, pa.binary())],
                    names=["_i", "_h", "n_tokens", "known", "logs", "score", "rare", "far"],
                )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                lists = [np.unique(np.frombuffer(x, np.int64), return_counts=True) for x in part.column("list").to_pylist()]
                row = np.repeat(np.arange(len(lists)), [len(x) for x, _ in lists])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in lists])), part.column("_i").take(pa.array(row)), part.column("_h").take(pa.array(row)), pa.array(np.concatenate([n for _, n in lists]).astype(np.int64))], names=["k", "_i", "_h", "m"])

    first = scratch.write(own.select("_i", "_h", text).mapInArrow(score, "_i long, _h long, n_tokens long, known long, logs double, score double, rare binary, far binary"))
    lists = lambda c: first.where(F.length(c) > 0).select("_i", "_h", F.col(c).alias("list")).distinct().mapInArrow(spread, "k long, _i long, _h long, m long")
    met = lists("rare").join(counts.where("kind = 0").select("k", "n"), "k").groupBy("_i", "_h").agg(F.sum("m").alias("more"), F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("add"))
    left = lists("far").join(values.select("k", "value"), "k").groupBy("_i", "_h").agg(F.sum(F.col("m") * F.col("value")).alias("rest"))
    same = (F.col("l._i").eqNullSafe(F.col("r._i"))) & (F.col("l._h") == F.col("r._h"))
    both = first.drop("rare", "far").distinct().alias("l").join(met.alias("r"), same, "left").select("l.*", "more", "add")
    both = both.alias("l").join(left.alias("r"), same, "left").select("l.*", "rest")
    lone = float(np.log10(tokens + distinct + 1))
    told = both.select(
        F.col("_i"), F.col("_h"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("add", F.lit(0.0)) + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * lone).alias("base_score"), (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
    told = scratch.write(told)
    scratch.drop(first)
    return own.alias("l").join(told.alias("r"), same, "left").select("l.*", *[f"r.{c}" for c in added]).drop("_i", "_h")


def op8_suffix_tree_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, fold() != 2)
    return out.select("doc_id", (fold() == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
