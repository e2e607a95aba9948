"""Paired tests by metric: Student's t and Wilcoxon's signed ranks with their p-values, over one row a group; what goes in steps is done for a batch of groups at once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.scratch import cut
from .evaluate import upper_tail
from .order import running

EXACT = 50  # pairs at most for exact null counts
ALONE = 1 << 16  # differences at most of a group that one task sorts
STEPS = 100_000  # of the continued fraction at most; it settles in some ten, and in about the root of a large number of pairs
SETTLED = 1e-15


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of x > 0: Stirling's series at x + 9, brought down by the recurrence."""
    # The series' coefficients
    series = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188]
    y = x + 9
    tail = sum((c / F.pow(y, F.lit(float(2 * k + 1))) for k, c in enumerate(series)), F.lit(0.0))
    product = F.lit(1.0)
    for k in range(9):
        product = product * (x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + tail - F.log(product)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function by Lentz's method; a row leaves once it is settled."""
    out, at, tiny = np.full(len(x), np.nan), np.arange(len(x)), 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones(len(x)), 1 / safe(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for k in range(1, STEPS + 1):
        if not len(at):
            return out
        even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        for n in (even, odd):
            c, d = safe(1 + n / c), 1 / safe(1 + n * d)
            h = h * c * d
        open_ = np.abs(c * d - 1) > SETTLED
        out[at[~open_]] = h[~open_]
        at, a, b, x, c, d, h = (v[open_] for v in (at, a, b, x, c, d, h))
    out[at] = h
    return out


@F.pandas_udf(DoubleType())
def _beta_fraction(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    """The fraction of each row, null where x is null or not between 0 and 1."""
    a, b, x = (v.to_numpy("float64") for v in (a, b, x))
    out, able = np.full(len(x), np.nan), (x > 0) & (x < 1)
    out[able] = _fraction(a[able], b[able], x[able])
    return pd.Series(out)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """I_x(a, b), regularised: its continued fraction by Lentz's method, on the side where it converges fast."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    near = x < (a + 1) / (a + b + 2)
    side = lambda this, other: F.when(near, this).otherwise(other)
    part = front * _beta_fraction(side(a, b), side(b, a), side(x, 1 - x))
    return F.when(F.isnan(x), x).when(x <= 0, 0.0).when(x >= 1, 1.0).when(near, part / a).otherwise(1 - part / b)


def t_tail(t: Column, freedom: Column) -> Column:
    """Two-sided p of Student's t."""
    return incomplete_beta(freedom / 2, F.lit(0.5), freedom / (freedom + t * t))


@F.pandas_udf(DoubleType())
def signed_rank_tail(least: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided exact p that a rank sum of n untied pairs is at most `least`: how many subsets of 1 to n have each sum, built one number at a time."""
    out, ways = pd.Series(np.nan, index=n.index), np.ones(1)
    for k in range(int(n.max()) + 1 if n.notna().any() else 0):
        if k:
            ways = np.concatenate([ways, np.zeros(k)]) + np.concatenate([np.zeros(k), ways])
        own = (n == k) & least.notna()
        if own.any():
            at = np.minimum(np.floor(least[own]).astype("int64"), len(ways) - 1)
            out[own] = np.minimum(1.0, 2 * np.cumsum(ways)[at] / 2.0**k)
    return out


def _sizes(rows: DataFrame) -> DataFrame:
    """(_b, _a, _c, _up) of rows (_b, _d): each group's distinct sizes, how many have them and how many of these are positive."""
    return rows.groupBy("_b", F.abs("_d").alias("_a")).agg(F.count("*").alias("_c"), F.count_if(F.col("_d") > 0).alias("_up"))


def _ranked_here(rows: DataFrame) -> DataFrame:
    """_sizes with _upto, how many differences other than 0 of the group are of at most this size; every group is sorted in one task."""
    here = Window.partitionBy("_b").orderBy("_a").rowsBetween(Window.unboundedPreceding, 0)
    return _sizes(rows.repartition("_b")).withColumn("_upto", F.sum(F.when(F.col("_a") != 0, F.col("_c")).otherwise(0)).over(here))


def _ranked_by_ranges(rows: DataFrame) -> DataFrame:
    """The same from running counts in order over the whole table, so no group is one task."""
    sizes = cut(_sizes(rows))
    ran = cut(running(sizes.where("_a <> 0"), F.col("_b"), F.col("_a"), sums={"_upto": "_c"}).select("_b", "_a", "_c", "_up", "_upto"))
    starts = ran.groupBy(F.col("_b").alias("_s")).agg(F.min(F.col("_upto") - F.col("_c")).alias("_start"))
    met = ran.join(starts, F.col("_b").eqNullSafe(F.col("_s"))).select("_b", "_a", "_c", "_up", (F.col("_upto") - F.col("_start")).alias("_upto"))
    return met.unionByName(sizes.where("_a = 0").withColumn("_upto", F.lit(0).cast("long")))


def signed_ranks(df: DataFrame, by: str, difference: str) -> DataFrame:
    """(by, n, zeros, ties, plus, minus, tied_cubes) of the differences of each group that are not null.

    Zeros are left out of the ranks; equal sizes share their mean rank. Groups of more than ALONE differences are ranked in order over the whole table, the others each
    in one task.
    """
    rows = df.where(F.col(difference).isNotNull()).select(F.col(by).alias("_b"), F.col(difference).cast("double").alias("_d"))
    large = cut(rows.groupBy(F.col("_b").alias("_l")).agg(F.count("*").alias("_n")).where(F.col("_n") > ALONE).select("_l"))  # one of ALONE rows at most
    if large.isEmpty():
        ranked = _ranked_here(rows)
    else:
        of = lambda how: rows.join(F.broadcast(large), F.col("_b").eqNullSafe(F.col("_l")), how)
        ranked = _ranked_here(of("left_anti")).unionByName(_ranked_by_ranges(of("left_semi")))
    other, c, up = F.col("_a") != 0, F.col("_c"), F.col("_up")
    rank = F.col("_upto") - c + (c + 1) / 2
    total = lambda x, none: F.coalesce(F.sum(F.when(other, x)), F.lit(none))
    cubes = F.pow(c.cast("double"), F.lit(3.0)) - c
    return ranked.groupBy(F.col("_b").alias(by)).agg(total(c, 0).alias("n"), F.coalesce(F.sum(F.when(~other, c)), F.lit(0)).alias("zeros"), F.count_if(other & (c > 1)).alias("ties"), total(rank * up, 0.0).alias("plus"), total(rank * (c - up), 0.0).alias("minus"), total(cubes, 0.0).alias("tied_cubes"))


def wilcoxon(df: DataFrame, by: str, difference: str) -> DataFrame:
    """signed_ranks with statistic (the smaller rank sum) and p_wilcoxon, two-sided.

    Exact for up to EXACT pairs without zeros and ties, else the normal approximation with the ties' correction; null without any difference other than 0.
    """
    n, least = F.col("n").cast("double"), F.least("plus", "minus")  # n cubed is beyond a long from 1.7 million pairs on
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tied_cubes") / 48)
    z = (least - n * (n + 1) / 4) / spread
    exact = (n <= EXACT) & (F.col("zeros") == 0) & (F.col("ties") == 0)
    p = F.when(n == 0, None).when(exact, signed_rank_tail(least, F.when(exact & (n > 0), n))).otherwise(F.least(F.lit(1.0), upper_tail(z * z)))
    return signed_ranks(df, by, difference).withColumns({"statistic": F.when(n > 0, least), "p_wilcoxon": p})


def paired_tests(df: DataFrame, metric: str, with_value: str, without_value: str, polarity: str) -> DataFrame:
    """Of each metric with two or more pairs: means, share of improvement in percent (by the metric's polarity, 1 or -1) and both tests.

    significant is Yes if the Wilcoxon p is under 0.05, else if the t p is. Differences that are all equal have no t.
    """
    rows = df.where(F.col(with_value).isNotNull() & F.col(without_value).isNotNull())
    pairs = rows.select(F.col(metric).alias("metric"), F.col(with_value).cast("double").alias("w"), F.col(without_value).cast("double").alias("o"), F.col(polarity).alias("polarity")).withColumn("d", F.col("w") - F.col("o"))
    got = pairs.groupBy("metric").agg(F.min("polarity").alias("polarity"), F.count("*").alias("n_pairs"), F.avg("w").alias("mean_with"), F.avg("o").alias("mean_without"), F.avg("d").alias("mean_delta"), F.stddev_samp("d").alias("_sd"), (100 * F.avg((F.col("d") * F.col("polarity") > 0).cast("double"))).alias("pct_improvement")).where("n_pairs > 1")
    t = F.try_divide("mean_delta", F.col("_sd") / F.sqrt("n_pairs"))
    tested = got.withColumn("t", t).withColumn("p_ttest", F.when(F.col("t").isNotNull(), t_tail(F.col("t"), F.col("n_pairs") - 1.0)))
    ranks = wilcoxon(pairs, "metric", "d").select(F.col("metric").alias("_m"), "statistic", "p_wilcoxon")
    sure = lambda c: F.coalesce(F.col(c) < 0.05, F.lit(False))
    met = tested.join(ranks, F.col("metric").eqNullSafe(F.col("_m"))).drop("_m", "_sd")
    return met.withColumn("significant", F.when(sure("p_wilcoxon") | sure("p_ttest"), "Yes").otherwise("No"))
