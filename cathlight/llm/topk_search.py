"""Exact top-k by inner product, over norm-sorted and rotated vectors (operator 4).

Components x become floor(64 * x). The corpus is dealt by descending length into blocks of about
BLOCK vectors. The rotation is that of the singular value decomposition (from the Gram matrix), so
the first components hold most of every inner product. The longest vectors, at most HEAD of them,
give each query a first score to beat. In a block, queries leave once length times length is below
their k-th score (Cauchy-Schwarz); of the others, the inner product of the first rotated components
plus the product of the residual lengths bounds each score, and what may reach the k-th score is
scored exactly in integers. A block's best k of each query meet those of the other blocks.

A stated query set goes to every block whose longest vector can still reach the first score, which is told before the shuffle, a few
thousand rows at a time; no pair leaves a block but those k. Vectors that are null, empty, hold a null or a non-finite component, or a component whose
floor(64 * x) is no 64-bit integer (the SQL fails on those) take no part. Scores beyond the exact range of
doubles are summed in integers; one among the k best that is no 64-bit integer is an error, as in SQL. Only vectors of one size meet. A query
is not its own neighbour: rows with its id are passed over. Equal rows of one id count once. Ties go
to the smaller id. Null ids take no part. Other columns are not part of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BLOCK, HEAD, CHUNK, QUERIES, FIRST = 16_384, 4096, 2048, 1024, 16
SLACK, ROUNDING = 1e-6, 1e-9  # the second times length times length


def vectors_of(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k best of their query."""
    by = np.lexsort((ids, -score, q))
    first = np.searchsorted(q[by], q[by], "left")
    return by[np.arange(len(by)) - first < k]


def exact_scores(q: np.ndarray, c: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q and c, whole numbers; lengths: length times length, which bounds every partial sum."""
    out = np.zeros(len(q), np.int64)
    for s in range(0, len(q), 65536):
        x, y, size = q[s : s + 65536], c[s : s + 65536], lengths[s : s + 65536]
        small, large = size < 2.0**52, size >= 2.0**62
        own = out[s : s + 65536]
        own[small] = np.einsum("ij,ij->i", x[small], y[small]).astype(np.int64)
        middle = ~small & ~large
        own[middle] = np.einsum("ij,ij->i", x[middle].astype(np.int64), y[middle].astype(np.int64))
        for i in np.flatnonzero(large).tolist():
            score = sum(int(a) * int(b) for a, b in zip(x[i].tolist(), y[i].tolist()))
            if not -(1 << 63) <= score < 1 << 63:
                raise OverflowError("a score is beyond 64-bit integers")
            own[i] = score
    return out


def last_block(edges: np.ndarray, lengths: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Of each query the last block whose longest vector (edges, falling) can still give it its least score; the first block at least."""
    falling = np.maximum.accumulate(edges[::-1])[::-1]
    need = np.where(least > 0, (least - SLACK * (1 + np.abs(least))) / np.maximum(lengths * (1 + ROUNDING), 1e-300), 0.0)
    return np.maximum(np.searchsorted(-falling, -need, "right") - 1, 0)


def search_block(rotation: np.ndarray, c: np.ndarray, c_ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the k best of each query that reach its least score; c is sorted by falling length."""
    cl, ql = np.sqrt((c * c).sum(1)), np.sqrt((q * q).sum(1))
    cr, qr = c @ rotation, q @ rotation
    first = min(FIRST, c.shape[1])
    rest = lambda x: np.sqrt((x[:, first:] ** 2).sum(1))
    c_rest, q_rest = rest(cr), rest(qr)
    least = least.copy()
    found: list[tuple] = []
    for a in range(0, len(c), CHUNK):
        b = min(a + CHUNK, len(c))
        live = np.flatnonzero(ql * cl[a] * (1 + ROUNDING) >= least - SLACK * (1 + np.abs(least)))
        if not len(live):
            continue
        loose = SLACK * (1 + np.abs(least[live])) + ROUNDING * ql[live] * cl[a]
        bound = qr[live, :first] @ cr[a:b, :first].T + q_rest[live, None] * c_rest[None, a:b]
        x, y = np.nonzero((bound >= (least[live] - loose)[:, None]) & (q_ids[live, None] != c_ids[None, a:b]))
        if len(x) > bound.size // 8:
            score = (q[live] @ c[a:b].T)[x, y]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", q[live[x[s : s + 65536]]], c[a + y[s : s + 65536]]) for s in range(0, len(x), 65536)] or [np.zeros(0)])
        keep = score >= (least[live] - loose)[x]
        x, y, score = live[x[keep]], a + y[keep], score[keep]
        size = ql[x] * cl[y]
        far = np.flatnonzero(size >= 2.0**52)
        score = score.astype(np.int64) if not len(far) else np.where(size < 2.0**52, score, 0).astype(np.int64)
        for s in range(0, len(far), 65536):
            at = far[s : s + 65536]
            score[at] = exact_scores(q[x[at]], c[y[at]], size[at])
        if found:
            x, y, score = (np.concatenate(p) for p in zip(found[0], (x, y, score)))
        own = best(x, c_ids[y], score, k)
        x, y, score = x[own], y[own], score[own]
        found = [(x, y, score)]
        n = np.bincount(x, minlength=len(q))
        full = np.flatnonzero(n >= k)
        last = np.searchsorted(x, full, "right") - 1
        least[full] = np.maximum(least[full], score[last])
    return found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    raw = F.col(vector_col).cast("array<double>")
    x = F.transform(raw, lambda c: F.floor(c * scale).cast("double"))
    fine = F.col(id_col).isNotNull() & raw.isNotNull() & (F.size(raw) > 0) & F.coalesce(F.forall(raw, lambda c: (c * scale >= -(2.0**63)) & (c * scale < 2.0**63)), F.lit(False))
    own = vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), x.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).distinct()
    n2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    own = own.select("id", "v", "asks", n2.alias("n2"), F.size("v").alias("dim"))
    total = own.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = max(1, -(-vectors.count() // BLOCK))
    # equal lengths are dealt by id, so a vector that many rows share does not fill a block
    dealt = scratch.write(own.repartitionByRange(blocks, F.desc("n2"), F.col("id")).withColumn("block", F.spark_partition_id()))
    main = total[0].dim
    top = dict(dealt.groupBy("block").agg(F.max("n2")).collect())  # a row a block
    edges = np.array([top.get(b, 0.0) for b in range(blocks)]) ** 0.5

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((main, main))
        for batch in batches:
            v = vectors_of(batch.column("v"))
            g += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(main * main)), pa.array(g.ravel())], names=["at", "x"])

    cells = dealt.where(F.col("dim") == main).select("v").mapInArrow(gram, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").toArrow()
    rotation = np.linalg.eigh(cells.column("x").to_numpy().reshape(main, main))[1][:, ::-1]
    longest = dealt.where(F.col("dim") == main).orderBy(F.desc("n2"), "id").limit(HEAD).select("id", "v").toArrow().combine_chunks()
    head_ids = longest.column("id").to_numpy()
    head = vectors_of(longest.column("v").combine_chunks() if isinstance(longest.column("v"), pa.ChunkedArray) else longest.column("v"))
    shared = spark.sparkContext.broadcast((rotation, head_ids, head, edges))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A score that each query's k-th best is known to reach, and the last block with a vector long enough for it."""
        _, head_ids, head, edges = shared.value
        for batch in batches:
            least, last = np.full(batch.num_rows, -np.inf), np.full(batch.num_rows, blocks - 1)
            dims = np.asarray(batch.column("dim"))
            rows = np.flatnonzero(dims == main)
            for s in range(0, len(rows), QUERIES):
                at = rows[s : s + QUERIES]
                v = vectors_of(batch.column("v").take(pa.array(at)))
                score = v @ head.T - ROUNDING * np.sqrt((v * v).sum(1))[:, None] * np.sqrt((head * head).sum(1))[None, :]
                score[np.asarray(batch.column("id"))[at][:, None] == head_ids[None, :]] = -np.inf
                if len(head) > k:
                    least[at] = np.partition(score, len(head) - k, axis=1)[:, len(head) - k]
                    last[at] = last_block(edges, np.sqrt((v * v).sum(1)), least[at])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("dim"), pa.array(least), pa.array(last)], names=["id", "v", "dim", "least", "last"])

    asked = dealt.where("asks").select("id", "v", "dim").mapInArrow(seed, "id long, v array<double>, dim int, least double, last long")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias("block"), "dim", F.lit(1).alias("kind"), "id", "v", "least")
    both = dealt.select("block", "dim", F.lit(0).alias("kind"), "id", "v", (-F.col("n2")).alias("least")).unionByName(asked)
    arranged = both.repartition(blocks, "block").sortWithinPartitions("block", "dim", "kind", "least", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation = shared.value[0]
        at, held, c, c_ids = None, [], None, None
        for batch in batches:
            block, dim, kind = (np.asarray(batch.column(x)).astype(np.int64) for x in ("block", "dim", "kind"))
            key = (block << 33) | (dim << 1) | kind
            cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                part = batch.slice(a, b - a)
                if at != key[a] >> 1:
                    at, held, c = key[a] >> 1, [], None
                if not kind[a]:
                    held.append((vectors_of(part.column("v")), np.asarray(part.column("id"))))
                    continue
                if not held:
                    continue
                if c is None:
                    c, c_ids = (np.concatenate(p) for p in zip(*held))
                turn = rotation if len(rotation) == c.shape[1] else np.eye(c.shape[1])
                q, q_ids, least = vectors_of(part.column("v")), np.asarray(part.column("id")), np.asarray(part.column("least"))
                for s in range(0, len(q), QUERIES):
                    x, y, score = search_block(turn, c, c_ids, q[s : s + QUERIES], q_ids[s : s + QUERIES], least[s : s + QUERIES], k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[s + x]), pa.array(c_ids[y]), pa.array(score.astype(np.int64))], names=["query_id", "vec_id", "score"])

    near = arranged.mapInArrow(run, "query_id long, vec_id long, score long").distinct()
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_exact_topk(spark, sf_dir: str) -> DataFrame:
    from .common import table

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 20 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
