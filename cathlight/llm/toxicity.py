"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams and skip-grams (operator 7).

A text's features are the distinct words, word stems (their first four and five bytes, for languages
whose words take many endings), word pairs and pairs one word apart, lower-cased (A-Z) and hashed
into 2**BITS buckets, and one bias. Training takes at most SAMPLE labelled rows, repeated ones counted, those with
the least hash of their id, and makes PASSES passes in that order in one bounded task; per-coordinate
rates and the L1 term leave few weights other than 0, and those alone are broadcast: at most 2**BITS.

Null and empty texts have only the bias. Labels that are null, or of rows without a document, are not
learned; of several labels of one id the largest counts. Without any label every score is 0.5. Other
columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, table

BITS, SAMPLE, PASSES = 20, 16_000, 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
STEMS = (4, 5)
GRAMS = ((0,), (0, 1), (0, 2))


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of each slice of rows: begin, end, feature and row (from 0) of every occurrence."""
    for i, j in K.slices(column, 2 << 20):
        words = K.Words(K.Texts(column[i:j]))
        h, found, rows = words.hashes(), [], []
        for gaps in GRAMS:
            g, at = words.grams(h, gaps)
            found.append((g >> np.uint64(64 - BITS)).astype(np.int64))
            rows.append(words.doc[at])
        for most in STEMS:
            found.append((K.mix(words.hashes(most) + K.MULT[most]) >> np.uint64(64 - BITS)).astype(np.int64))
            rows.append(words.doc)
        yield i, j, np.concatenate(found), np.concatenate(rows)


def train(examples: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Weights of all buckets and, last, the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i) -> np.ndarray:
        return np.where(np.abs(z[i]) <= L1, 0.0, (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(PASSES):
        for y, own in examples:
            i = np.append(own, size - 1)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / ALPHA * w
    return weights(np.arange(size))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(bucket, weight) of the weights that are not 0. labels holds the rows to learn from."""
    own = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y is not null")
    sample = own.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    chosen = texts.join(F.broadcast(sample), "_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            column = K.plain(batch, "_text")
            for i, j, f, row in features(column):
                key = np.unique(row << BITS | f)
                cut = np.searchsorted(key, np.arange(j - i + 1) << BITS)
                sets = [(key[a:b] & ((1 << BITS) - 1)).astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_y"), pa.array(sets, pa.binary())], names=["_id", "_y", "_f"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        examples = [(y, np.frombuffer(f, np.int32)) for b in batches for y, f in zip(b.column("_y").to_pylist(), b.column("_f").to_pylist())]
        w = train(examples)
        i = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(w[i])], names=["bucket", "weight"])

    encoded = chosen.mapInArrow(encode, "_id long, _y int, _f binary")
    bounded = encoded.orderBy(F.xxhash64("_id"), "_id", "_y", "_f").limit(SAMPLE)  # an id may have any number of rows
    return bounded.repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id", "_f").mapInArrow(learn, "bucket long, weight double")


def scored(docs: DataFrame, model: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a score from 0 to 1; a column of that name is replaced."""
    got = model.collect()  # at most 2**BITS weights
    index = np.array([r.bucket for r in got], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((index, np.array([r.weight for r in got], np.float64)))
    docs = docs.drop("score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        index, value = shared.value
        w = np.zeros((1 << BITS) + 1)
        w[index] = value
        some = w != 0
        for batch in batches:
            out = np.full(batch.num_rows, w[-1])
            for i, j, f, row in features(K.plain(batch, text_col)):
                hit = some[f]
                key = np.unique(row[hit] << BITS | f[hit])
                out[i:j] += np.bincount(key >> BITS, w[key & ((1 << BITS) - 1)], j - i)
            score = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, score double")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def model_of(spark, sf_dir: str, docs: DataFrame) -> DataFrame:
    """The weights learned from the labelled rows of docs that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic")
    return Scratch(spark, "toxic").write(fit(docs, labels))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, model_of(spark, sf_dir, docs))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
