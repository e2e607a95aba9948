"""Closest template of a text by its matching-blocks ratio, by bounds that lose no match.

The ratio is 2 M / T: M characters lie in matching blocks, T is the length of both texts. Blocks come in one order in both texts, so M is at most the length of
their longest common subsequence, and this at most the number of characters that they share. Every text meets every template whose length allows
the threshold, in cells of so many texts and templates that go from the cheap bound to the dear one; what is left is compared in full, the highest bound
first, until no bound reaches the best ratio found. A cell holds its two blocks and tells one row a text, so nothing of a pair is written.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..sources.scratch import cut
from .curate import first_by
from .order import numbered

BLOCK = 4096  # texts and templates at most (texts: about) that meet in a cell
CELLS, TASKS = 64, 1024  # at least, so that small tables are dealt too; at most
WIDE = 256  # characters at most of a template that is kept as a row of codes
BITS = 64  # characters at most of a text whose common subsequences with many templates are found at once


def common_length(text: str, template: str) -> int:
    """The length of the longest common subsequence, a row of its table as the bits of a number."""
    places, rest = {}, (1 << len(text)) - 1
    whole = rest
    for i, c in enumerate(text):
        places[c] = places.get(c, 0) | 1 << i
    for c in template:
        met = rest & places.get(c, 0)
        rest = (rest + met | rest - met) & whole
    return len(text) - rest.bit_count()


class Templates:
    """A block of templates: how often each has every character, and the codes of those that are not long by place."""

    def __init__(self, texts: list[str], order: list):
        self.texts, self.order = texts, order
        self.sizes = np.array([len(t) for t in texts], "int64")
        self.code = {c: i for i, c in enumerate(sorted(set().union(*texts)))}
        self.counts = np.zeros((len(self.code), len(texts)), "int32")
        self.codes = np.full((min(int(self.sizes.max()), WIDE), len(texts)), len(self.code), "int32")
        for j, t in enumerate(texts):
            own = np.array([self.code[c] for c in t], "int64")
            np.add.at(self.counts[:, j], own, 1)
            if len(t) <= WIDE:
                self.codes[: len(t), j] = own

    def common(self, text: str, at: np.ndarray) -> np.ndarray:
        """common_length of a text and the templates at some places."""
        out, slow = np.zeros(len(at), "int64"), (self.sizes[at] > WIDE) | (len(text) > BITS)
        out[slow] = [common_length(text, self.texts[j]) for j in at[slow]]
        fast = at[~slow]
        if len(fast):
            places = np.zeros(len(self.code) + 1, "uint64")  # none for the code after a text's end
            for i, c in enumerate(text):
                if c in self.code:
                    places[self.code[c]] |= np.uint64(1 << i)
            whole = np.uint64((1 << len(text)) - 1)
            rest = np.full(len(fast), whole)
            for row in self.codes[: int(self.sizes[fast].max())]:
                met = rest & places[row[fast]]
                rest = rest + met | rest - met
            out[~slow] = len(text) - np.bitwise_count(rest & whole).astype("int64")
        return out

    def closest(self, text: str, least: float) -> tuple[int, int | None, float | None]:
        """How many were compared in full, and place and ratio of the best (the least order of equals), if it reaches the least."""
        bound = lambda shared, at: 2.0 * shared / np.maximum(len(text) + self.sizes[at], 1)
        every = np.arange(len(self.texts))
        at = every[bound(np.minimum(self.sizes, len(text)), every) >= least]
        shared = np.zeros(len(at), "int64")
        for c in set(text) & self.code.keys():
            shared += np.minimum(self.counts[self.code[c]][at], text.count(c))
        at = at[bound(shared, at) >= least]
        most = bound(self.common(text, at), at)
        at, most = at[most >= least], most[most >= least]
        done, best, score = 0, None, None
        for i in sorted(range(len(at)), key=lambda i: (-most[i], self.order[at[i]])):
            if best is not None and (most[i] < score or most[i] == score and self.order[at[i]] >= self.order[best]):
                break
            ratio, done = SequenceMatcher(None, text, self.texts[at[i]]).ratio(), done + 1
            if ratio >= least and (best is None or (ratio, -self.order[at[i]]) > (score, -self.order[best])):
                best, score = int(at[i]), ratio
        return done, best, score


def _best(texts: DataFrame, templates: DataFrame, threshold: float) -> DataFrame:
    """(id, candidates, match, score, order) of texts (id, text) and templates (text, order): a row a text and block of templates of fitting lengths."""
    placed = cut(numbered(templates.withColumn("size", F.length("text")), "size", "text", start=0).withColumn("block", F.floor(F.col("place") / BLOCK)))
    blocks = cut(placed.groupBy(F.col("block").alias("_block")).agg(F.min("size").alias("low"), F.max("size").alias("high")))  # a row a block
    n_blocks, n_texts = blocks.count(), texts.count()
    buckets = max(-(-n_texts // BLOCK), -(-CELLS // max(n_blocks, 1)))
    tasks = max(1, min(n_blocks * buckets, TASKS))
    size, able = F.length("text"), lambda a, b: 2 * F.least(a, b) >= (a + b) * threshold - 1e-9
    near = F.greatest(F.col("low"), F.least(F.col("high"), size))  # the block's length nearest to the text's
    left = texts.join(F.broadcast(blocks), able(near, size)).select(F.col("_block").alias("block"), F.pmod(F.xxhash64("text"), F.lit(buckets)).cast("int").alias("bucket"), "id", "text")
    right = placed.select("block", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "text", "order")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        got = []
        if len(left) and len(right):
            block = Templates(right["text"].tolist(), right["order"].tolist())
            for i, text in zip(left["id"], left["text"]):
                done, j, score = block.closest(text, threshold)
                got.append((i, done, None if j is None else block.texts[j], score, None if j is None else block.order[j]))
        return pd.DataFrame(got, columns=["id", "candidates", "match", "score", "order"], dtype="object")

    keys, out = ["block", "bucket"], StructType([StructField("id", LongType()), StructField("candidates", LongType()), StructField("match", StringType()), StructField("score", DoubleType()), StructField("order", templates.schema["order"].dataType)])
    dealt = lambda df: df.repartition(tasks, *keys).groupBy(*keys)
    return dealt(left).cogroup(dealt(right)).applyInPandas(meet, out)


def closest_templates(texts: DataFrame, text: str, templates: DataFrame, template: str, order: str, threshold: float) -> DataFrame:
    """(text, match, score, strategy, candidates) of each different text that is not null: its best template of at least the threshold, the first by `order` of equals.

    strategy is exact, fuzzy or none; candidates tells how many templates were compared in full. Below the threshold there is no match and no score. The ratio is not symmetric: the text comes first.
    """
    own = cut(texts.select(F.col(text).alias("text")).where("text is not null").distinct().withColumn("id", F.monotonically_increasing_id()))
    known = cut(first_by(templates.where(F.col(template).isNotNull()).select(F.col(template).alias("text"), F.col(order).alias("order")), ["text"], F.asc("order")))
    exact = own.join(known.select("text"), "text", "left_semi")
    rest = own.join(known.select("text"), "text", "left_anti")
    found = _best(rest, known, float(threshold))
    best = found.groupBy(F.col("id").alias("left")).agg(F.sum("candidates").alias("candidates"), F.max_by("match", F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("order")).alias("o")))).alias("match"), F.max("score").alias("score"))
    met = rest.join(best, rest["id"] == best["left"], "left")
    fuzzy = met.select("text", F.when(F.col("score").isNotNull(), F.col("match")).alias("match"), "score", F.when(F.col("score").isNotNull(), "fuzzy").otherwise("none").alias("strategy"), F.coalesce("candidates", F.lit(0)).alias("candidates"))
    same = exact.select("text", F.col("text").alias("match"), F.lit(1.0).alias("score"), F.lit("exact").alias("strategy"), F.lit(0).cast("long").alias("candidates"))
    return fuzzy.unionByName(same).withColumnRenamed("text", text)


def options_for(texts: DataFrame, text: str, templates: DataFrame, template: str, order: str, options: str, threshold: float, rules: list[tuple[str, Column, Column]], default: tuple[str, Column]) -> DataFrame:
    """closest_templates with the options (an array) of the match; without one, those of the first rule (name, condition on the text, options) that holds, else the default's, and that name as strategy."""
    got = closest_templates(texts, text, templates, template, order, threshold)
    lists = first_by(templates.select(F.col(template).alias("match"), F.col(options).alias("_options"), F.col(order).alias("_order")), ["match"], F.asc("_order")).drop("_order")
    met = got.join(lists, "match", "left")
    chosen, name = F.col("_options"), F.col("strategy")
    none = F.col("strategy") == "none"
    ladder_options, ladder_name = default[1], F.lit(default[0])
    for label, holds, listed in reversed(rules):
        ladder_options, ladder_name = F.when(holds, listed).otherwise(ladder_options), F.when(holds, label).otherwise(ladder_name)
    return met.select(text, "match", "score", F.when(none, ladder_name).otherwise(name).alias("strategy"), "candidates", F.when(none, ladder_options).otherwise(chosen).alias("options"))
