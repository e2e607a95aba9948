"""Scores of generated texts against their references: BLEU, ROUGE-1, ROUGE-2 and ROUGE-L.

n-grams are counted as rows of a pair, not in the pair's arrays, and counts of a task's own rows are added before the shuffle, so a
pair of very long texts is many rows and no quadratic work. Only the longest common subsequence needs a pair in one place: its table is a column
of bits, a whole number of as many bits as the reference has words, and each word of the other text is one step on it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

EPSILON = 0.1  # takes the place of no match, for orders above the first


def spaced_words(text: Column) -> Column:
    """Words between white space, lower-cased; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """Runs of a-z and 0-9 after lower-casing, as they stand (without stemming); null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    if n == 1:
        return words
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def matched(pairs: DataFrame, key: str, reference: str, generated: str, orders: int) -> DataFrame:
    """(key, n, hits, ours, theirs) of two columns of words: n-grams that match, each at most as often as both have it, and how many there are."""
    sides = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(s).alias("side"), _grams(F.col(c), n).alias("grams")) for n in range(1, orders + 1) for s, c in ((0, reference), (1, generated))))
    rows = pairs.select(F.col(key).alias("_key"), F.inline(sides)).select("_key", "n", "side", F.explode("grams").alias("gram"))
    counts = rows.groupBy("_key", "n", "gram").agg(F.count_if(F.col("side") == 1).alias("a"), F.count_if(F.col("side") == 0).alias("b"))
    return counts.groupBy(F.col("_key").alias(key), "n").agg(F.sum(F.least("a", "b")).alias("hits"), F.sum("a").alias("ours"), F.sum("b").alias("theirs"))


def bleu(df: DataFrame, key: str, reference: str, generated: str, orders: int = 4) -> DataFrame:
    """(key, bleu) of every row: the geometric mean of the clipped precisions of 1 to `orders` words, with a penalty for texts shorter than their reference.

    An order without a match counts EPSILON matches; without a single word in common the score is 0. Keys are distinct; empty and null texts score 0.
    """
    pairs = df.select(F.col(key), spaced_words(F.col(reference)).alias("_r"), spaced_words(F.col(generated)).alias("_g"))
    got = matched(pairs, key, "_r", "_g", orders)
    share = F.log(F.when(F.col("hits") == 0, EPSILON).otherwise(F.col("hits")) / F.greatest(F.col("ours"), F.lit(1)))
    sums = got.groupBy(key).agg(
        F.sum(F.when(F.col("ours") + F.col("theirs") > 0, share)).alias("_log"), F.count("*").alias("_met"), F.max(F.when(F.col("n") == 1, F.col("hits"))).alias("_hits"),
        F.max(F.when(F.col("n") == 1, F.col("ours"))).alias("_ours"), F.max(F.when(F.col("n") == 1, F.col("theirs"))).alias("_theirs"),
    )
    # an order that neither text is long enough for has no row: no match of one
    mean = (F.col("_log") + (orders - F.col("_met")) * F.log(F.lit(EPSILON))) / orders
    short = F.when(F.col("_ours") > F.col("_theirs"), 0.0).otherwise(1 - F.col("_theirs") / F.col("_ours"))
    score = F.when(F.col("_hits") > 0, F.exp(mean + short)).otherwise(0.0)
    return df.select(key).join(sums.select(key, score.alias("_bleu")), key, "left").select(key, F.coalesce("_bleu", F.lit(0.0)).alias("bleu"))


def f_measure(hits: Column, ours: Column, theirs: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * hits, (ours + theirs).cast("double")), F.lit(0.0))


@F.pandas_udf(LongType())
def common_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two lists of words."""

    def one(x, y) -> int:
        at: dict[str, int] = {}
        for i, w in enumerate(x):
            at[w] = at.get(w, 0) | 1 << i
        full = (1 << len(x)) - 1
        rest = full  # a 0 for every word of x at which a longest one of its beginning grows
        for w in y:
            hit = rest & at.get(w, 0)
            rest = ((rest + hit) | (rest - hit)) & full
        return len(x) - rest.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int64")


def rouge(df: DataFrame, key: str, reference: str, generated: str) -> DataFrame:
    """(key, rouge1, rouge2, rougeL) of every row: F-measures of matching words, pairs of words and the longest common subsequence. Keys are distinct."""
    pairs = df.select(F.col(key), plain_words(F.col(reference)).alias("_r"), plain_words(F.col(generated)).alias("_g"))
    got = matched(pairs, key, "_r", "_g", 2).groupBy(key).agg(*(F.max(F.when(F.col("n") == n, f_measure(F.col("hits"), F.col("ours"), F.col("theirs")))).alias(f"rouge{n}") for n in (1, 2)))
    longest = pairs.select(key, f_measure(common_words("_r", "_g"), F.size("_g"), F.size("_r")).alias("rougeL"))
    return longest.join(got, key, "left").select(key, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("rouge1", "rouge2", "rougeL")))


def term_coverage(df: DataFrame, key: str, reference: str, generated: str, terms: list[str]) -> DataFrame:
    """(key, wanted, found, coverage): which of some terms the reference has in any case, and which of those the generated text has; no terms cover nothing."""
    low = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in (reference, generated)}
    wanted = F.filter(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: low[reference].contains(t))
    found = F.filter(F.col("wanted"), lambda t: low[generated].contains(t))
    out = df.select(key, reference, generated, wanted.alias("wanted")).withColumn("found", found)
    return out.select(key, F.size("wanted").alias("wanted"), F.size("found").alias("found"), F.coalesce(F.try_divide(F.size("found").cast("double"), F.size("wanted")), F.lit(0.0)).alias("coverage"))
