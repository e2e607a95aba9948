"""Language of texts by sparse multinomial logistic regression on TF-IDF character n-grams (operator 13).

A text is lower-cased; letters and the marks on them stay, every run of anything else is one space, and a space stands before
and after the text. Its features are the runs of 1 to GRAMS of these characters, without the lone space, hashed into 2**BITS buckets (fewer
with many languages, so that buckets times languages stay within 2**TABLE). A feature weighs its share of the text's
runs times its inverse document frequency, which is counted over all rows to learn from. Training takes at most SAMPLE rows (those
with the least hash of their id; repeated rows once, and rows with at most 2**PAIRS features together), in one bounded task: follow the
regularised leader with per-coordinate rates and an elastic net (L1 and L2), PASSES times over four fifths of them. The last fifth sets the
temperature that its likelihood is greatest with; a score is the probability of the best language at that temperature.

A null text, or one without any letter, is UNKNOWN with the score 0, and so is every text if there is nothing to learn from. Rows with a null
language aren't learned from. Equal scores go to the first language by name. Repeated rows are scored alike; texts of any length are read
whole. Columns of docs named lang_pred or score are replaced, all others are kept.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, table

BITS, TABLE, GRAMS = 16, 22, 3
SAMPLE, PAIRS, PASSES, CALIBRATE = 16_000, 24, 3, 5
SCALE, ALPHA, BETA, L1, L2 = 100.0, 1.0, 1.0, 1.0, 0.1
UNKNOWN = "und"
ROWS = 512  # of a slice, whose features are marked in a table of rows and buckets
_kinds: list[np.ndarray] = []


def kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point, whether it is a letter, and whether it is a letter or a mark."""
    if not _kinds:
        category = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        letter = np.array([c == "L" for c in category])
        _kinds.extend([letter, letter | np.array([c == "M" for c in category])])
    return _kinds[0], _kinds[1]


def runs(texts: list[str], bits: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Whether each text has a letter, and for every length of run its buckets and the text of each, in order."""
    letter, inner = kinds()
    framed = [f" {t.lower()} " for t in texts]
    code = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in framed])
    has = np.zeros(len(texts), bool)
    has[doc[letter[code]]] = True
    space = ~inner[code]
    keep = np.ones(len(code), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (doc[1:] == doc[:-1]))
    c, doc = np.where(space, 32, code)[keep].astype(np.uint64), doc[keep]
    out, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, GRAMS + 1):
        h = (h[: len(c) - n + 1] + c[n - 1 :]) * K.MULT[n - 1]
        h ^= h >> np.uint64(32)
        own = doc[: len(h)]
        whole = own == doc[n - 1 :] if n > 1 else c != 32
        out.append(((h[whole] * K.MULT[6] >> np.uint64(64 - bits)).astype(np.int64), own[whole]))
    return has, out


def parts(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    """Slices of a text column of at most ROWS rows."""
    for i, j in K.slices(column, most):
        for a in range(i, j, ROWS):
            yield a, min(j, a + ROWS), column[a : min(j, a + ROWS)].to_pylist()


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], size: int, classes: int) -> np.ndarray:
    """Weights (size + 1, classes), the bias last, from (class, features, values)."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(i) -> np.ndarray:
        return np.where(np.abs(z[i]) <= L1, 0.0, (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(PASSES):
        for y, own, value in examples:
            i, x = np.append(own, size), np.append(value, 1.0)
            w = weights(i)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / ALPHA * w
    return weights(np.arange(size + 1))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits from 1/16 to 16 with which the classes y are likeliest; 1 without rows."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-300).mean()
    low, high = -4.0, 4.0
    for _ in range(60):  # the loss falls, then rises
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(2.0**a) <= loss(2.0**b) else (a, high)
    return float(2.0 ** ((low + high) / 2))


class Model:
    """Languages by name, their number of buckets, weights times inverse document frequency, biases and temperature."""

    def __init__(self, names: list[str], bits: int, index: np.ndarray, rows: np.ndarray, bias: np.ndarray, heat: float):
        self.names, self.bits, self.index, self.rows, self.bias, self.heat = names, bits, index, rows, bias, heat

    def place(self) -> None:
        """The table of all buckets, once a task."""
        self.at = np.full(1 << self.bits, -1, np.int64)
        self.at[self.index] = np.arange(len(self.index))

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        has, found = runs(texts, self.bits)
        total, sums = np.zeros(len(texts)), np.zeros((len(texts), len(self.names)))
        for f, doc in found:
            total += np.bincount(doc, minlength=len(texts))
            at = self.at[f]
            hit = at >= 0
            at, doc = at[hit], doc[hit]
            if len(at):
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                sums[doc[first]] += np.add.reduceat(self.rows[at], first, axis=0)
        return has, self.bias + SCALE * sums / np.maximum(total, 1)[:, None]


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the languages of the rows that `learn` says; None without any."""
    spark = docs.sparkSession
    h = F.xxhash64(F.col(id_col))
    rows = docs.where(F.coalesce(learn, F.lit(False)) & F.col(lang_col).isNotNull())
    least = rows.select(h.alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    if least is None:
        return None
    chosen = rows.where(F.col(text_col).isNotNull() & (h <= least)).select(h.alias("_h"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))
    names = [r[0] for r in chosen.select("_lang").distinct().orderBy("_lang").collect()]  # at most as many as are learned from, but for repeated ids
    if not names:
        return None
    bits = max(1, min(BITS, TABLE - (len(names) - 1).bit_length()))
    size = 1 << bits

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        count, n = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for i, j, texts in parts(K.plain(batch, "_text")):
                seen = np.zeros((j - i) << bits, bool)
                for f, doc in runs(texts, bits)[1]:
                    seen[doc << bits | f] = True
                count[:size] += seen.reshape(j - i, size).sum(axis=0)
                n += j - i
        count[size] = n
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["f", "n"])

    got = rows.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("_text")).mapInArrow(frequency, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()  # at most 2**BITS + 1 rows
    count = np.zeros(size + 1)
    count[got.column("f").to_numpy()] = got.column("n").to_numpy()
    rarity = np.log((1 + count[size]) / (1 + count[:size])) + 1
    shared = spark.sparkContext.broadcast(rarity)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            for i, j, texts in parts(K.plain(batch, "_text")):
                found = runs(texts, bits)[1]
                key, n = np.unique(np.concatenate([doc << bits | f for f, doc in found]), return_counts=True)
                cut = np.searchsorted(key, np.arange(j - i + 1) << bits)
                features = [(key[a:b] & (size - 1)).astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                counts = [n[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("_h"), part.column("_lang"), pa.array(features, pa.binary()), pa.array(counts, pa.binary())], names=["_h", "_lang", "_f", "_n"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        examples, room, of = [], 1 << PAIRS, {name: k for k, name in enumerate(names)}
        for batch in batches:
            for lang, f, n in zip(*(batch.column(c).to_pylist() for c in ("_lang", "_f", "_n"))):
                room -= len(f) // 4
                if room >= 0 and f:
                    own, tf = np.frombuffer(f, np.int32), np.frombuffer(n, np.int32)
                    examples.append((of[lang], own, SCALE * tf / tf.sum() * shared.value[own]))
        tested = examples[CALIBRATE - 1 :: CALIBRATE]
        w = train([e for k, e in enumerate(examples) if k % CALIBRATE != CALIBRATE - 1], size, len(names))
        logits = np.array([x @ w[own] + w[-1] for _, own, x in tested]).reshape(len(tested), len(names))
        heat = temperature(logits, np.array([y for y, _, _ in tested], int))
        some = np.append(np.flatnonzero(w[:-1].any(axis=1)), size)
        for a in range(0, len(some), 4096):
            own = some[a : a + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(w[own]), pa.list_(pa.float64())), pa.array(np.full(len(own), heat))], names=["f", "w", "heat"])

    encoded = chosen.dropDuplicates().mapInArrow(encode, "_h long, _lang string, _f binary, _n binary")
    bounded = encoded.orderBy("_h", "_lang", "_f", "_n").limit(SAMPLE)
    weights = Scratch(spark, "language").write(bounded.repartition(1).sortWithinPartitions("_h", "_lang", "_f", "_n").mapInArrow(learned, "f long, w array<double>, heat double"))
    got = weights.orderBy("f").toArrow()  # at most 2**BITS + 1 rows, 2**TABLE numbers
    f = got.column("f").to_numpy()
    w = np.array(got.column("w").to_pylist()).reshape(len(f), len(names))
    return Model(names, bits, f[:-1], w[:-1] * rarity[f[:-1], None], w[-1], float(got.column("heat")[0].as_py()))


def identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        model = shared.value
        model.place()
        for batch in batches:
            best, score = [], np.zeros(batch.num_rows)
            for i, j, texts in parts(K.plain(batch, text_col)):
                has, logits = model.logits(texts)
                top = logits.argmax(axis=1)
                score[i:j] = np.where(has, softmax(logits / model.heat).max(axis=1), 0.0)
                best += [model.names[k] if known else UNKNOWN for k, known in zip(top.tolist(), has.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"), fold() != 0)
    return identified(docs.select("doc_id", "text"), model).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
