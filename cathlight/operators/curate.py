"""Keys, duplicates, overlaps, splits and resumable writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key, the first in the given order; Spark keeps one row a key in each task before the shuffle (WindowGroupLimit)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def copies(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Rows whose key repeats, with copy_index (from 1) and total_copies."""
    keyed = df.withColumn("_key", key)
    own = Window.partitionBy("_key")
    return keyed.withColumns({"copy_index": F.row_number().over(own.orderBy(order)), "total_copies": F.count("*").over(own)}).where("total_copies > 1").drop("_key")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """in_both, only_left, only_right and the share of left in both, percent; one pass over both sides."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))).where(F.col(key).isNotNull())
    flags = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    out = flags.agg(F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("in_both"), F.count_if(F.col("r") == 0).alias("only_left"), F.count_if(F.col("l") == 0).alias("only_right"))
    return out.withColumn("coverage", F.round(100.0 * F.col("in_both") / (F.col("in_both") + F.col("only_left")), 1))


def append_new(target: DataFrame, rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """target and the rows of keys it lacks, first of equals: insert-or-ignore."""
    return target.unionByName(first_by(rows, keys, *order).join(target, keys, "left_anti"))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """target with the last of rows for each key they name: insert-or-replace."""
    return target.join(rows, keys, "left_anti").unionByName(first_by(rows, keys, *order))


BUCKETS = 1024


def hash_rank(df: DataFrame, key: str, label: str, seed: int = 0) -> DataFrame:
    """df with _rn, each row's place (from 1) in the hashed order of its label, and _n, the label's rows.

    Places are counted in buckets of the hash, and a bucket begins where the ones before it end, so a label
    with a third of all rows is no single task.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    rows = df.withColumns({"_h": h, "_b": F.pmod(F.shiftright(h, 20), F.lit(BUCKETS)), "_l": F.col(label)})
    counts = rows.groupBy("_l", "_b").agg(F.count("*").alias("_c"))
    own = Window.partitionBy("_l")  # at most BUCKETS rows a label
    starts = counts.select(F.col("_l").alias("_l2"), F.col("_b").alias("_b2"), (F.sum("_c").over(own.orderBy("_b")) - F.col("_c")).alias("_start"), F.sum("_c").over(own).alias("_n"))
    met = rows.join(starts, F.col("_l").eqNullSafe(F.col("_l2")) & (F.col("_b") == F.col("_b2")))
    place = F.row_number().over(Window.partitionBy("_l", "_b").orderBy("_h", key))
    return met.withColumn("_rn", F.col("_start") + place).drop("_h", "_b", "_l", "_l2", "_b2", "_start")


def split_groups(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """dev true for a share of the keys (at least one, not all), by their hashed order; a key is on one side."""
    ranked = hash_rank(df.select(key).distinct().withColumn("_all", F.lit(0)), key, "_all", seed)
    take = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.bround(F.col("_n") * share).cast("bigint")))
    dev = ranked.where(F.col("_rn") <= take).select(key, F.lit(True).alias("dev"))
    return df.join(dev, key, "left").withColumn("dev", F.coalesce("dev", F.lit(False)))


def stratified_folds(df: DataFrame, key: str, label: str, folds: int) -> DataFrame:
    """fold 0 to folds - 1; labels with fewer rows than folds are left out."""
    return hash_rank(df, key, label).where(F.col("_n") >= folds).withColumn("fold", ((F.col("_rn") - 1) % folds).cast("int")).drop("_n", "_rn")


def holdout(df: DataFrame, key: str, label: str, share: float) -> DataFrame:
    """train true for round(n * share) rows of each label, at least one on both sides."""
    n = F.col("_n")
    take = F.greatest(F.lit(1), F.least(n - 1, F.bround(n * share).cast("bigint")))
    return hash_rank(df, key, label).withColumn("train", F.col("_rn") <= take).drop("_n", "_rn")


def sample_strata(df: DataFrame, key: str, label: str, size) -> DataFrame:
    """size(n) rows of each label of n rows, by hashed order."""
    return hash_rank(df, key, label).where(F.col("_rn") <= size(F.col("_n"))).drop("_n", "_rn")


def bipartite(df: DataFrame, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    """Distinct edges and nodes (side, name, degree, size) of two columns."""
    edges = df.select(F.col(left).alias("source"), F.col(right).alias("target")).where("source is not null and target is not null").distinct()
    ends = edges.select(F.inline(F.array(F.struct(F.lit("left").alias("side"), F.col("source").alias("name")), F.struct(F.lit("right").alias("side"), F.col("target").alias("name")))))
    nodes = ends.groupBy("side", "name").agg(F.count("*").alias("degree"))
    return edges, nodes.withColumn("size", F.least(F.lit(60), 12 + 3 * F.col("degree")))


def co_occurrence(df: DataFrame, key: str, item: str) -> DataFrame:
    """How many keys have both of two items (a < b); a key's items are a short list, gathered by grouping."""
    sets = df.groupBy(key).agg(F.sort_array(F.collect_set(item)).alias("s"))
    pairs = sets.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
