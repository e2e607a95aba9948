"""Scores, agreement and significance from counts: one grouped pass, closed forms after it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .quantiles import wide_quantiles


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def confusion(df: DataFrame, by: list[str], truth: str, predicted: str) -> DataFrame:
    """tp, tn, fp, fn of each group; truth and predicted are 0 or 1."""
    t, p = F.col(truth), F.col(predicted)
    return df.groupBy(*by).agg(
        F.count_if((p == 1) & (t == 1)).alias("tp"), F.count_if((p == 0) & (t == 0)).alias("tn"),
        F.count_if((p == 1) & (t == 0)).alias("fp"), F.count_if((p == 0) & (t == 1)).alias("fn"),
    )


def with_scores(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall and F1 of class 1; macro and support-weighted precision, recall and F1."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    n, yes, no = tp + tn + fp + fn, tp + fn, tn + fp
    p1, r1, p0, r0 = ratio(tp, tp + fp), ratio(tp, yes), ratio(tn, tn + fn), ratio(tn, no)
    f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    weighted = lambda a, b: ratio(a * yes + b * no, n)
    return counts.withColumns(
        {"n": n, "accuracy": ratio(tp + tn, n), "precision": p1, "recall": r1, "f1": f1, "f1_no": f0, "f1_macro": (f1 + f0) / 2,
         "precision_weighted": weighted(p1, p0), "recall_weighted": weighted(r1, r0), "f1_weighted": weighted(f1, f0)}
    )


def controls(df: DataFrame, predicted: str, key: str) -> DataFrame:
    """Long form of a prediction and its controls: original, flipped, all-yes, all-no and hashed coin."""
    p = F.col(predicted)
    forms = [("original", p), ("flipped", 1 - p), ("all_yes", F.lit(1)), ("all_no", F.lit(0)), ("random", F.pmod(F.crc32(F.col(key).cast("string")), F.lit(2)).cast("int"))]
    return df.select("*", F.inline(F.array(*[F.struct(F.lit(n).alias("control"), x.cast("int").alias("answer")) for n, x in forms])))


def paired(df: DataFrame, truth: str, first: str, second: str) -> DataFrame:
    """b: first right and second wrong, c the reverse, with McNemar's p.

    Exact for b + c < 20, else chi-square with continuity correction.
    """
    x, y = F.col(first) == F.col(truth), F.col(second) == F.col(truth)
    counts = df.agg(F.count_if(x & y).alias("both_right"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("both_wrong"))
    n, k = F.col("b") + F.col("c"), F.least("b", "c")
    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k), F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")), lambda s, i: F.struct((s["sum"] + s["term"]).alias("sum"), (s["term"] * (n - i) / (i + 1)).alias("term")))
    exact = F.least(F.lit(1.0), 2 * tail["sum"] / F.pow(F.lit(2.0), n))
    chi = F.when(n > 0, F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2.0)) / n).otherwise(0.0)
    return counts.withColumns({"chi_square": chi, "p": F.when(n == 0, 1.0).when(n < 20, exact).otherwise(upper_tail(chi))})


def upper_tail(chi: Column) -> Column:
    """P(X >= chi) of one degree of freedom: erfc by a rational approximation (error under 1.2e-7)."""
    z = F.sqrt(chi / 2)
    t = 1 / (1 + 0.5 * z)
    # Coefficients of the published rational approximation of erfc
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(c[-1])
    for x in reversed(c[:-1]):
        poly = poly * t + x
    return t * F.exp(-z * z + poly)


def kappa(df: DataFrame, first: str, second: str) -> DataFrame:
    """Observed and chance agreement and Cohen's kappa of two annotators."""
    pairs = df.groupBy(F.col(first).alias("x"), F.col(second).alias("y")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.inline(F.array(F.struct(F.col("x").alias("v"), F.col("n").alias("a"), F.lit(0).cast("bigint").alias("b")), F.struct(F.col("y").alias("v"), F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b")))))
    chance = sides.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).agg(F.sum(F.col("a") * F.col("b")).cast("double").alias("ab"))
    same = pairs.agg(F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"), F.sum("n").alias("n"))
    both = same.join(F.broadcast(chance))  # one row each
    po, pe = ratio(F.col("same"), F.col("n")), F.col("ab") / (F.col("n") * F.col("n"))
    return both.select("n", po.alias("po"), pe.alias("pe"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a proportion, within 0 and 1; the proportion itself without trials."""
    p = ratio(k, n)
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    some = lambda x: F.when(n > 0, x).otherwise(p)
    return some(F.greatest(F.lit(0.0), middle - half)), some(F.least(F.lit(1.0), middle + half))


def cochran(n: Column, p: float = 0.5, e: float = 0.05, z: float = 1.96) -> Column:
    """Sample size for a population of n."""
    n0 = z * z * p * (1 - p) / (e * e)
    return F.least(n, F.bround(n0 / (1 + (n0 - 1) / n)).cast("bigint"))


def describe(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, median, spread, quartiles, and bias-corrected skew and excess kurtosis; the quartiles by counted digits, so no group's values are in one place."""
    v, by = F.col(value).cast("double"), by or []
    got = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.var_samp(v).alias("variance"), F.min(v).alias("lowest"), F.max(v).alias("highest"),
        F.skewness(v).alias("_g1"), F.kurtosis(v).alias("_g2"),
    )
    quart = wide_quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    if by:
        quart = quart.select(*(F.col(c).alias(f"_q_{c}") for c in by), "q1", "median", "q3")
        got = got.join(quart, [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in by], "left")
    else:
        got = got.join(F.broadcast(quart))  # one row each
    n = F.col("n").cast("double")
    return got.withColumns(
        {"iqr": F.col("q3") - F.col("q1"), "skew": F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)),
         "kurtosis": F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6))}
    ).drop("_g1", "_g2", *(f"_q_{c}" for c in by))


def concentration(df: DataFrame, key: str) -> DataFrame:
    """Total, distinct, top-1 and top-3 share, Herfindahl index and share of singletons of a column's values."""
    counts = df.groupBy(key).agg(F.count("*").alias("c"))
    sums = counts.agg(F.sum("c").alias("total"), F.count("*").alias("distinct_values"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.count_if(F.col("c") == 1).alias("singletons"))
    top = counts.orderBy(F.desc("c"), key).limit(3).agg(F.max("c").alias("t1"), F.sum("c").alias("t3"))
    return sums.join(F.broadcast(top)).select(
        "total", "distinct_values", ratio(F.col("t1"), F.col("total")).alias("top1"), ratio(F.col("t3"), F.col("total")).alias("top3"),
        (F.col("sq") / (F.col("total") * F.col("total"))).alias("hhi"), "singletons", ratio(F.col("singletons"), F.col("distinct_values")).alias("singleton_ratio"),
    )


def ema(df: DataFrame, by: str, order: str, value: str, keep: float = 0.98) -> DataFrame:
    """The last exponential moving average of each group, seeded by its first value."""
    xs = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("x")))), lambda s: s["x"])
    return df.groupBy(by).agg(xs.alias("xs")).select(by, F.aggregate("xs", F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x).otherwise(a * keep + x * (1 - keep))).alias("ema"))


def paired_t(df: DataFrame, by: list[str], before: str, after: str) -> DataFrame:
    """n, mean and deviation of paired differences and their t."""
    d = F.col(after).cast("double") - F.col(before)
    got = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_delta"), F.stddev_samp(d).alias("sd_delta"), F.avg((d > 0).cast("double")).alias("improved"))
    return got.withColumn("t", F.try_divide("mean_delta", F.col("sd_delta") / F.sqrt("n")))


def contrastive_loss(pairs: DataFrame, query: str, item: str, similarity: str, scale: float = 1.0) -> DataFrame:
    """Mean symmetric cross-entropy of matching pairs (equal ids) in a long similarity matrix."""
    s = pairs.select(F.col(query).alias("q"), F.col(item).alias("i"), (F.col(similarity) * scale).alias("s"))

    def side(by: str) -> DataFrame:
        top = s.groupBy(by).agg(F.max("s").alias("m"))
        rest = s.join(top, by).groupBy(by, "m").agg(F.sum(F.exp(F.col("s") - F.col("m"))).alias("z"))
        return rest.select(F.col(by).alias("k"), (F.col("m") + F.log("z")).alias("lse"))

    own = s.where("q = i").select(F.col("q").alias("k"), "s")
    both = own.join(side("q").withColumnRenamed("lse", "a"), "k").join(side("i").withColumnRenamed("lse", "b"), "k")
    return both.agg(F.avg((F.col("a") + F.col("b")) / 2 - F.col("s")).alias("loss"))


def sigmoid_loss(pairs: DataFrame, query: str, item: str, similarity: str, scale: float = 10.0, bias: float = -10.0) -> DataFrame:
    """Mean of -log sigmoid(y (t s + b)) over all pairs, y 1 for equal ids and -1 for others."""
    z = F.when(F.col(query) == F.col(item), 1.0).otherwise(-1.0) * (F.col(similarity) * scale + bias)
    return pairs.agg(F.avg(F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))).alias("loss"))


def streak(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """best so far and steps since it improved, in each group."""
    own = Window.partitionBy(by).orderBy(order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    fresh = df.withColumns({"best": F.min(value).over(upto), "_prior": F.min(value).over(own.rowsBetween(Window.unboundedPreceding, -1)), "_at": F.row_number().over(own)})
    marked = fresh.withColumn("_hit", F.when(F.col("_prior").isNull() | (F.col(value) < F.col("_prior")), F.col("_at")))
    return marked.withColumn("since", F.col("_at") - F.max("_hit").over(upto)).drop("_prior", "_at", "_hit")


@F.pandas_udf(DoubleType())
def _resampled(replicate: pd.Series, seed: pd.Series, n: pd.Series, up: pd.Series, down: pd.Series) -> pd.Series:
    """The difference of accuracies of one resample: how often it draws a row of each kind is multinomial, and that is a binomial of all draws, then one of those left."""

    def one(r, s, n, up, down):
        rng = np.random.default_rng([s, r])
        a = rng.binomial(n, up / n)
        b = rng.binomial(n - a, down / (n - up)) if n > up else 0
        return (a - b) / n

    return pd.Series([one(*x) for x in zip(replicate, seed, n, up, down)], dtype="float64")


def bootstrap_delta(df: DataFrame, truth: str, first: str, second: str, replicates: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Both accuracies, their difference (first less second), its mean and percentile bounds over resamples of all rows, and whether these leave out 0.

    Rows matter only by their difference (1, 0 or -1), so a resample is one exact draw of three counts; the same seed gives the same bounds
    however the replicates are dealt. Without rows there is no row.
    """
    hit = lambda c: (F.col(c) == F.col(truth)).cast("int")
    d = hit(first) - hit(second)
    counts = df.where(d.isNotNull()).agg(F.count("*").alias("n"), F.avg(hit(first).cast("double")).alias("first_accuracy"), F.avg(hit(second).cast("double")).alias("second_accuracy"), F.count_if(d == 1).alias("up"), F.count_if(d == -1).alias("down")).where("n > 0")
    reps = df.sparkSession.range(replicates).join(F.broadcast(counts))  # one row
    drawn = reps.withColumn("delta", _resampled("id", F.lit(seed), "n", "up", "down"))
    got = drawn.groupBy("n", "up", "down", "first_accuracy", "second_accuracy").agg(F.avg("delta").alias("mean_delta"), F.percentile("delta", F.lit(alpha / 2)).alias("low"), F.percentile("delta", F.lit(1 - alpha / 2)).alias("high"))
    got = got.withColumn("delta", (F.col("up") - F.col("down")) / F.col("n"))
    return got.withColumn("significant", F.when((F.col("low") > 0) | (F.col("high") < 0), "Yes").otherwise("No"))
