"""Exact nearest neighbours and what is scored from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

QUERY_LIMIT, ITEM_LIMIT = 4096, 16_384


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _scores(queries: pa.Table, items: pa.Table, together: bool):
    """Of some queries at a time: the index of the first, and cosines with all items; -inf for a query's own id, and for items apart from it."""
    q, c = _matrix(queries.column("_v")), _matrix(items.column("_v"))
    q_ids, ids, q_side, side = (t.column(n).to_numpy() for n in ("_id", "_apart") for t in (queries, items))
    for a in range(0, len(q), 256):
        score, same = np.round(q[a : a + 256] @ c.T, 9), q_side[a : a + 256, None] == side
        score[(q_ids[a : a + 256, None] == ids) | (~same if together else same)] = -np.inf
        yield a, score


def best_of_block(k: int, together: bool = False):
    """The k best items of each query of one block of queries and one of items, as (query_id, id, similarity)."""

    def run(queries: pa.Table, items: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and items.num_rows:
            q_ids, ids = queries.column("_id").to_numpy(), items.column("_id").to_numpy()
            for a, score in _scores(queries, items, together):
                least = np.partition(score, -k, axis=1)[:, -k] if k < len(ids) else np.full(len(score), -np.inf)
                for i, row in enumerate(score):
                    own = np.flatnonzero((row >= least[i]) & (row > -np.inf))
                    own = own[np.lexsort((ids[own], -row[own]))[:k]]
                    out.append((np.full(len(own), q_ids[a + i]), ids[own], row[own]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table([pa.array(c) for c in columns], names=["query_id", "_item", "similarity"])

    return run


def better_in_block(queries: pa.Table, items: pa.Table) -> pa.Table:
    """How many items of a block come before each query's target (_goal, _goal_id): (query_id, better)."""
    n = np.zeros(queries.num_rows, np.int64)
    if queries.num_rows and items.num_rows:
        goal, goal_id, ids = queries.column("_goal").to_numpy(), queries.column("_goal_id").to_numpy(), items.column("_id").to_numpy()
        for a, score in _scores(queries, items, False):
            g = goal[a : a + len(score), None]
            n[a : a + len(score)] = ((score > g) | ((score == g) & (ids < goal_id[a : a + len(score), None]))).sum(axis=1)
    return pa.table([queries.column("_id"), pa.array(n)], names=["query_id", "better"])


def _blocks(queries: DataFrame, items: DataFrame, id_col: str, vector_col: str, apart: str | None, *kept: str):
    """Both sides by the blocks in which they meet; items whose `apart` is null belong to no query's side."""
    rows = lambda df, none, *more: df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), V.unit(F.col(vector_col)).alias("_v"), (F.coalesce(F.col(apart).cast("long"), F.lit(none)) if apart else F.lit(none)).cast("long").alias("_apart"), F.size(vector_col).alias("_dim"), *more)
    blocks = lambda df, most: max(1, -(-df.count() // most))
    many, parts = blocks(queries, QUERY_LIMIT), blocks(items, ITEM_LIMIT)
    own = lambda n: F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["_bq", "_bi", "_dim"]
    q = rows(queries, -1, *kept).withColumn("_bq", own(many)).withColumn("_bi", each(parts))
    c = rows(items, -2).withColumn("_bi", own(parts)).withColumn("_bq", each(many))
    return q.groupBy(*keys).cogroup(c.groupBy(*keys))


def nearest(queries: DataFrame, items: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", apart: str | None = None, together: bool = False) -> DataFrame:
    """(query_id, id, similarity, rank) of the k items of greatest cosine (to nine places), ties by id, a query's own id aside.

    Queries and items meet in blocks of about QUERY_LIMIT and ITEM_LIMIT rows; a block gives its k best of each query, so no pair
    leaves it but those. Items whose `apart` is the query's are passed over (with `together`, all others). Null vectors take no
    part, and only vectors of one size meet. Both sides are counted while the result is planned.
    """
    found = _blocks(queries, items, id_col, vector_col, apart).applyInArrow(best_of_block(k, together), "query_id long, _item long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "_item")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("_item").alias(id_col), "similarity", "rank")


def first_match_rank(queries: DataFrame, items: DataFrame, label: str = "label", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, first): the rank of each query's nearest item of its own label among all items; queries without one are not there.

    The nearest match is found first; then every block only counts what comes before it, so pairs are never ranked.
    """
    best = nearest(queries, items, 1, id_col, vector_col, label, together=True).select(F.col("query_id").alias(id_col), F.col("similarity").alias("_goal"), F.col(id_col).alias("_goal_id"))
    counts = _blocks(queries.join(best, id_col), items, id_col, vector_col, None, "_goal", "_goal_id").applyInArrow(better_in_block, "query_id long, better long")
    return counts.groupBy("query_id").agg((F.sum("better") + 1).alias("first"))


def vote(neighbours: DataFrame, label: str = "label") -> DataFrame:
    """(query_id, predicted): the most frequent label among neighbours, the nearest of equals."""
    counts = neighbours.groupBy("query_id", label).agg(F.count("*").alias("votes"), F.min("rank").alias("best"))
    order = Window.partitionBy("query_id").orderBy(F.desc("votes"), "best")
    return counts.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("query_id", F.col(label).alias("predicted"))


def descriptor(df: DataFrame, by: str, vector_col: str) -> DataFrame:
    """Mean and population deviation of each dimension of a group, end to end, at unit length."""
    cells = df.select(by, F.posexplode(vector_col).alias("at", "x")).groupBy(by, "at").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    sides = F.sort_array(F.collect_list(F.struct("at", "m", "s")))
    return cells.groupBy(by).agg(sides.alias("c")).select(by, V.unit(F.concat(F.transform("c", lambda s: s["m"]), F.transform("c", lambda s: s["s"]))).alias("descriptor"))


def similar_cases(query: DataFrame, items: DataFrame, attributes: DataFrame, key: str, n: int, fetch: int = 40) -> DataFrame:
    """Over-fetched neighbours grouped by a key: the n keys of best similarity, with their attributes."""
    near = nearest(query, items, fetch).join(items.select("vec_id", key), "vec_id")
    best = near.groupBy("query_id", key).agg(F.max("similarity").alias("similarity"), F.count("*").alias("hits"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).join(attributes, key, "left")
