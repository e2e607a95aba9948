"""Exact quantiles of any size, and thresholds that are calibrated on them and kept.

A double is turned into a long that sorts as it does, so the rows that hold a rank are found digit by digit: a pass counts how
many rows begin with each value of the next DIGIT bits, among the rows that begin as what is sought does, and keeps the one that
holds the rank. After 64 / DIGIT passes (fewer, once all that is left is one value) the value is told. A pass keeps at most
2**DIGIT counts a group and rank, never a group's values.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .curate import first_by

DIGIT = 16
FEW = 100_000  # ranks that are sought at most when their table is broadcast


def ordered_key(v: Column) -> Column:
    """A long that sorts as the double does: its exponent and mantissa, negative for negative numbers; NaN comes after infinity, -0.0 is 0.0."""
    a = F.abs(v)
    guess = F.floor(F.log2(a)).cast("int")
    e = F.when(a < F.pow(F.lit(2.0), guess), guess - 1).when(a >= F.pow(F.lit(2.0), guess + 1), guess + 1).otherwise(guess)
    e = F.greatest(F.lit(-1022), F.coalesce(e, F.lit(-1022)))
    bits = (e + 1022).cast("long") * (1 << 52) + (a / F.pow(F.lit(2.0), e) * float(1 << 52)).cast("long")
    bits = F.when(F.isnan(v), F.lit((2047 << 52) + 1)).when(a == float("inf"), F.lit(2047 << 52)).when(a == 0, F.lit(0)).otherwise(bits)
    return F.when((v < 0) & ~F.isnan(v), -bits).otherwise(bits).cast("long")


def quantiles(df: DataFrame, value: str, probabilities: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, p, n, quantile): the exact quantile of each group's values for each p, linear between neighbours; nulls take no part.

    A group without values has no row.
    """
    by = by or []
    v = F.col(value).cast("double")
    group = F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("all"))
    rows = df.where(v.isNotNull()).select(group.alias("_g"), v.alias("_v"), ordered_key(v).alias("_k"))
    at = F.col("_p") * (F.col("_n") - 1)
    sizes = rows.groupBy("_g").agg(F.count("*").alias("_n"))
    asked = cut(sizes.select("_g", "_n", F.explode(F.array(*map(F.lit, map(float, probabilities)))).alias("_p")).withColumns({"_low": F.floor(at), "_share": at - F.floor(at), "_high": F.least(F.floor(at) + 1, F.col("_n") - 1)}))
    ranks = asked.select("_g", F.explode(F.array("_low", "_high")).alias("_rank")).distinct()
    sought = cut(ranks.select(F.col("_g").alias("_s"), "_rank", F.col("_rank").alias("_left"), F.lit(None).cast("long").alias("_begin")))
    hint = F.broadcast if sought.count() <= FEW else lambda x: x
    told = None
    for shift in range(64 - DIGIT, -1, -DIGIT):
        same = F.col("_g").eqNullSafe(F.col("_s"))
        begins = F.lit(True) if told is None else F.col("_begin") == F.shiftright("_k", shift + DIGIT)
        own = rows if told is None else rows.join(hint(sought.select("_s", "_begin").distinct()), same & begins, "left_semi")
        heads = own.groupBy("_g", F.shiftright("_k", shift).alias("_head")).agg(F.count("*").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        within = F.lit(True) if told is None else F.col("_begin") == F.shiftright("_head", DIGIT)
        met = heads.join(hint(sought), same & within)
        listed = met.groupBy("_s", "_rank", "_left").agg(F.sort_array(F.collect_list(F.struct("_head", "_c", "_min", "_max"))).alias("_all"))  # at most 2**DIGIT counts
        start = F.struct(F.col("_left").alias("left"), F.lit(None).cast("struct<_head:bigint,_c:bigint,_min:double,_max:double>").alias("hit"))
        walk = F.aggregate("_all", start, lambda s, x: F.when(s["hit"].isNotNull(), s).when(s["left"] < x["_c"], F.struct(s["left"].alias("left"), x.alias("hit"))).otherwise(F.struct((s["left"] - x["_c"]).alias("left"), s["hit"].alias("hit"))))
        found = cut(listed.withColumn("_w", walk).select("_s", "_rank", F.col("_w.left").alias("_left"), F.col("_w.hit._head").alias("_begin"), F.col("_w.hit._min").alias("_min"), F.col("_w.hit._max").alias("_max")))
        one = F.col("_min").eqNullSafe(F.col("_max"))
        done = found.where(one).select("_s", "_rank", F.col("_min").alias("_value"))
        told = done if told is None else told.unionByName(done)
        sought = found.where(~one).select("_s", "_rank", "_left", "_begin")
        if sought.isEmpty():
            break
    low, high = (told.select(F.col("_s").alias(f"{x}_s"), F.col("_rank").alias(f"{x}_rank"), F.col("_value").alias(f"{x}_value")) for x in ("l", "h"))
    met = asked.join(low, F.col("_g").eqNullSafe(F.col("l_s")) & (F.col("_low") == F.col("l_rank"))).join(high, F.col("_g").eqNullSafe(F.col("h_s")) & (F.col("_high") == F.col("h_rank")))
    between = F.when(F.col("l_value") == F.col("h_value"), F.col("l_value")).otherwise(F.col("l_value") + (F.col("h_value") - F.col("l_value")) * F.col("_share"))
    return met.select(*(F.col(f"_g.{c}") for c in by), F.col("_p").alias("p"), F.col("_n").alias("n"), between.alias("quantile"))


def wide_quantiles(df: DataFrame, value: str, named: dict[str, float], by: list[str]) -> DataFrame:
    """(by, one column a name) of quantiles."""
    got = quantiles(df, value, list(named.values()), by)
    return got.groupBy(*by).agg(*(F.max(F.when(F.col("p") == float(p), F.col("quantile"))).alias(c) for c, p in named.items()))


# How far thresholds lie beyond what was seen, their caps and places
MARGIN = 1.15
THRESHOLDS = {"MASK_MAX_STD": ("std", 1.0, None, 2), "MASK_MAX_MEAN": ("mean", 1.0, 255.0, 2), "MASK_MIN_MEAN": ("mean", 0.03, None, 2), "MASK_MAX_BRIGHT_FRAC": ("bright_frac", 1.0, 1.0, 4), "MASK_MAX_ENTROPY": ("entropy", 1.0, None, 4)}


def thresholds(frames: DataFrame, sequence: str, frame: str) -> DataFrame:
    """(name, value): bounds for mask frames, from each sequence's frame of the least deviation (the first of equals).

    The largest value times the margin, with a cap where there is one, or the third percentile over the margin.
    """
    candidates = cut(first_by(frames.where("std is not null"), [sequence], F.asc("std"), F.asc(frame)))
    out = None
    for name, (column, p, cap, places) in THRESHOLDS.items():
        value = candidates.agg(F.max(column).alias("quantile")) if p == 1.0 else quantiles(candidates, column, [p])
        bound = F.col("quantile") * MARGIN if p == 1.0 else F.col("quantile") / MARGIN
        row = value.select(F.lit(name).alias("name"), F.round(F.least(bound, F.lit(cap)) if cap else bound, places).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out.where("value is not null")


def fingerprint(df: DataFrame, *settings: object) -> str:
    """Of a table's rows, in any order, and some settings: how many rows, two sums of their hashes, the schema."""
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    got = df.agg(F.count("*"), F.sum(F.xxhash64(row).cast("decimal(38,0)")), F.sum(F.crc32(row).cast("decimal(38,0)"))).first()
    return json.dumps([*map(str, got), df.schema.simpleString(), *map(str, settings)])


def kept_thresholds(frames: DataFrame, sequence: str, frame: str, folder: str, learn: Callable[[DataFrame, str, str], DataFrame] = thresholds) -> tuple[DataFrame, bool]:
    """thresholds(), and whether they were taken from the table in `folder`: only if it has every name with a number and was made of the same frames and margin.

    A table that can't be read, lacks a name or was made of others is written anew, beside the old one first, and put in its place by a rename.
    """
    spark = frames.sparkSession
    mark = fingerprint(frames.select(sequence, frame, "std", "mean", "bright_frac", "entropy"), MARGIN)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    schema = "name string, value double, made_of string"
    if store.exists(path):
        old = spark.read.schema(schema).json(folder).where((F.col("made_of") == mark) & F.col("value").isNotNull())
        if {r.name for r in old.select("name").distinct().collect()} >= set(THRESHOLDS):  # five names
            return old.select("name", "value"), True
    fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}.new")
    learn(frames, sequence, frame).select("name", "value", F.lit(mark).alias("made_of")).coalesce(1).write.mode("overwrite").json(f"{folder}.new")
    store.delete(path, True)
    store.rename(fresh, path)
    return spark.read.schema(schema).json(folder).select("name", "value"), False
