"""Removal of repeated byte strings (operator 9) by distributed prefix doubling.

A string of `length` bytes that starts earlier too (in a text of a smaller id, or earlier in the
same text) is a repeat, and every byte that a repeat covers goes. Suffixes are ranked at growing
offsets; Spark sorts the ranks of each round, and a suffix whose rank is unique leaves the work:

1. 32 bytes. Of every window of `length` bytes, the 32-byte prefix with the least name among the
   window's positions is its anchor. Equal windows have equal anchors at equal places, so all
   windows of an anchor whose rank nobody shares are unique and leave. Anchors are about 3 % of all
   positions, and only their ranks are counted over the corpus. The windows of an anchor that stays
   make one stretch of text; sorted by rank and text, stretches that came earlier repeat whole, and
   one of each kind goes on.
2. 64 bytes, by pairs of ranks (p, p + 32), for the suffixes that begin at the anchor and 32 bytes
   before it. A repeated window holds one of the two whole, so windows that hold neither as a shared
   rank leave.
3. `length` bytes, by pairs (p, p + length - 64), for every window that is left. Sorted by that rank and a second
   name, so that no byte goes on the word of 64 bits, the first in corpus order stays and the others are repeats.

Ranks are content names (64-bit hashes) instead of ordinals: equal strings have equal names, so a
round is one sort of the names that are left. Texts that are wholly equal are one beforehand.
Ranks that a very large number of anchors share would crowd one task: their stretches and windows
meet by grouped minima with partial aggregation and a join instead. Ranks are counted and tables
written while the result is planned.

Nulls and empty texts have no bytes and lose none. A text of 2**30 bytes or more, beyond what a Spark string column can carry through Arrow with its
context, is an error. Rows with a null id keep their bytes and take
no other part. Equal rows (same id, same text) count once and get the same result; different texts
of one id are ordered by a hash of their contents. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch

BITS = 1 << 27  # of a filter that is broadcast, 16 MB whatever the input
FILTER = BITS // 8  # ranks beyond which a join takes the filter's place
HOT = 20_000  # anchors of one rank beyond which grouped minima take the place of a sort
GRAM, HALF = 32, 64
BROADCAST = 1_000_000  # hot ranks, 8 bytes each


def anchors(raw: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The 32-byte ranks of all positions, the position of each anchor, and the first and last window start that it stands for."""
    none = np.zeros(0, np.int64)
    if len(raw) >= 1 << 30:
        raise ValueError("a text of 2**30 bytes or more")
    size = np.diff(start)
    if not len(raw) or not (size >= length).any():
        return none.view(np.uint64), none, none, none
    name = K.name32(np.concatenate([raw, np.zeros(GRAM, np.uint8)]))
    low = np.uint64((1 << 30) - 1)
    key = (name & ~low) | np.arange(len(name), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:]) if len(key) > width else key[:0]
        width *= 2
    if width < span and len(key):
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    at = (key & low).astype(np.int64)
    whole = np.zeros(len(raw) + 1, np.int64)
    fits = size >= length
    np.add.at(whole, start[:-1][fits], 1)
    np.add.at(whole, start[1:][fits] - length + 1, -1)
    p = np.flatnonzero(np.cumsum(whole)[: len(at)] > 0)
    at = at[p]
    new = np.ones(len(p), bool)
    new[1:] = (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    a = at[first]
    return name, a, p[first], p[last]


def rank(short: np.ndarray, p: np.ndarray, length: int) -> np.ndarray:
    """The rank of the `length` bytes from each p, by pairs of ranks of half the reach; short: the 32-byte ranks."""
    if length == GRAM:
        return short[p]
    reach = GRAM
    while 2 * reach < length:
        reach *= 2
    return K.mix((rank(short, p, reach) * K.MULT[0]) ^ (rank(short, p + length - reach, reach) + K.MULT[1]) * K.MULT[2])


def second_name(short: np.ndarray, p: np.ndarray, length: int) -> np.ndarray:
    """Another name of the `length` bytes from each p, of the same 32-byte ranks put together in another way."""
    out = np.full(len(p), np.uint64(length), np.uint64)
    for k, at in enumerate([*range(0, length - GRAM, GRAM), length - GRAM]):
        out = (out ^ short[p + at]) * K.MULT[3 + k % 4]
        out ^= out >> np.uint64(32)
    return out


def short_ranks(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """32-byte ranks over some stretches laid end to end, and where each stretch begins."""
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    return K.name32(np.concatenate([raw, np.zeros(GRAM, np.uint8)])), np.cumsum(size) - size


class Sorted:
    """Rows sorted by keys, then in corpus order: which are the first of their keys, and which come later (not the first one's repeated row)."""

    def __init__(self, keys: list[str], places: list[str]):
        self.keys, self.places, self.key, self.first = keys, places, None, None

    def meet(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys, places = ([np.asarray(batch.column(c)) for c in x] for x in (self.keys, self.places))
        new = np.zeros(batch.num_rows, bool)
        for i, k in enumerate(keys):
            new[1:] |= k[1:] != k[:-1]
            new[0] |= self.key is None or self.key[i] != k[0]
        at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        late = np.zeros(len(new), bool)
        for i, x in enumerate(places):
            late |= x != np.where(at >= 0, x[at], x[0] if self.first is None else self.first[i])
        self.key = [k[-1] for k in keys]
        if at[-1] >= 0:
            self.first = [x[at[-1]] for x in places]
        return new, late


def bits_of(batches: DataFrame, column: str) -> np.ndarray:
    """A filter of BITS bits with those of a column of ranks."""
    spot = F.pmod(F.col(column), F.lit(BITS)) + 1
    bits = np.zeros(BITS // 8, np.uint8)
    for r in batches.groupBy(F.bitmap_bucket_number(spot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("m")).collect():  # at most BITS / 8 bytes
        bits[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(bytes(r.m), np.uint8)
    return bits


def within(bits: np.ndarray, rank: np.ndarray) -> np.ndarray:
    spot = (rank.view(np.int64) % BITS).astype(np.int64)
    return (bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> tuple[Scratch, DataFrame, DataFrame]:
    """(scratch, first, spans): first has the (_id, _h) of each distinct text's first row, spans the runs _lo to _hi of window starts that repeat in those texts."""
    if length < 64:
        raise ValueError("length must be at least 64")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).where("_id is not null")
    sums = base.select("_id", F.xxhash64("_text").alias("_h"), F.crc32("_text").alias("_c"), F.octet_length("_text").alias("_n"))
    first = scratch.write(sums.where(F.col("_n") >= length).groupBy("_h", "_c", "_n").agg(F.min("_id").alias("_id")).select("_id", "_h"))
    own = base.where(F.octet_length("_text") >= length).withColumn("_h", F.xxhash64("_text")).join(first, ["_id", "_h"], "left_semi")

    halves = length >= 3 * GRAM  # else a window need not hold one of the two suffixes of round 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            column = K.plain(batch, "_text")
            for i, j in K.slices(column):
                t = K.Texts(column[i:j])
                short, a, _, _ = anchors(t.bytes, t.start, length)
                name, n = np.unique(short[a], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(n.astype(np.int32))], names=["g", "n"])

    ranks = scratch.write(own.select("_text").mapInArrow(count, "g long, n int").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1"))
    sizes = ranks.agg(F.count("*").alias("all"), F.count_if(F.col("n") > HOT).alias("hot")).first()
    filtered = sizes["all"] <= FILTER
    shared = spark.sparkContext.broadcast(bits_of(ranks, "g")) if filtered else None

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Round 1: the stretches (_lo to _hi, and length bytes from there) of anchors (_at) whose rank is shared, by rank and text."""
        K.release()
        for batch in batches:
            column, ids, sums = K.plain(batch, "_text"), np.asarray(batch.column("_id")), np.asarray(batch.column("_h"))
            for i, j in K.slices(column):
                t = K.Texts(column[i:j])
                short, at, lo, hi = anchors(t.bytes, t.start, length)
                if shared is not None:
                    keep = np.flatnonzero(within(shared.value, short[at]))
                    at, lo, hi = at[keep], lo[keep], hi[keep]
                w = K.mix(rank(short, lo, length) + K.mix(rank(short, hi, length) + (hi - lo).astype(np.uint64)))
                doc = np.searchsorted(t.start, lo, "right") - 1
                raw = t.bytes.tobytes()
                context = [raw[a : b + length] for a, b in zip(lo.tolist(), hi.tolist())]
                columns = [short[at].view(np.int64), w.view(np.int64), ids[i:j][doc], sums[i:j][doc], lo - t.start[doc], hi - t.start[doc], at - t.start[doc]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), pa.array(context, pa.binary())], names=["g", "w", "_id", "_h", "_lo", "_hi", "_at", "_context"])

    found = own.mapInArrow(emit, "g long, w long, _id long, _h long, _lo long, _hi long, _at long, _context binary")
    if not filtered:
        found = found.join(ranks.select("g"), "g", "left_semi")
    stretch = ["_id", "_h", "_lo", "_hi", "_at", "_context"]
    schema = "_id long, _h long, _lo long, _hi long, _at long, _context binary, right long, left long"

    def halved(part: pa.RecordBatch) -> pa.RecordBatch:
        """Round 2: with the 64-byte ranks from the anchor (right) and from 32 bytes before it (left), null where the stretch has no such bytes."""
        short, begin = short_ranks(part.column("_context").to_pylist())
        lo, hi, at = (np.asarray(part.column(c)) for c in ("_lo", "_hi", "_at"))
        sides = []
        for start in (at, at - GRAM):
            fits = (start >= lo) & (start + HALF <= hi + length)
            value = rank(short, np.where(fits, begin + start - lo, 0), HALF) if len(short) else np.zeros(0, np.uint64)
            sides.append(pa.array(value.view(np.int64), mask=~fits))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in stretch), *sides], names=[*stretch, "right", "left"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by (g, w): the first of each with its halves, the others without their text."""
        K.release()
        state = Sorted(["g", "w"], ["_id", "_h", "_lo"])
        for batch in batches:
            if batch.num_rows:
                new, late = state.meet(batch)
                for k in range(0, batch.num_rows, 20_000):
                    yield halved(batch.slice(k, 20_000).filter(pa.array(new[k : k + 20_000])))
                rest = batch.filter(pa.array(late))
                none = pa.nulls(rest.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in stretch[:-1]), pa.nulls(rest.num_rows, pa.binary()), none, none], names=[*stretch, "right", "left"])

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            for k in range(0, batch.num_rows, 20_000):
                yield halved(batch.slice(k, 20_000))

    cold = found
    if sizes["hot"]:
        hot = ranks.where(F.col("n") > HOT).select("g")
        hot = F.broadcast(hot) if sizes["hot"] <= BROADCAST else hot  # a longer list is joined like any other table
        cold = found.join(hot, "g", "left_anti")
        crowd = scratch.write(found.join(hot, "g", "left_semi"))
        place = F.struct("_id", "_h", "_lo", "_hi", "_at")
        head = crowd.groupBy("g", "w").agg(F.min(F.struct(*stretch)).alias("head"))
        ends = head.select("g", "w", *(F.col(f"head.{c}").alias(f"x{c}") for c in stretch[:-1]))
        late = crowd.drop("_context").join(ends, ["g", "w"]).where(place > F.struct(*(f"x{c}" for c in stretch[:-1])))
        none = [F.lit(None).cast(c).alias(n) for n, c in (("_context", "binary"), ("right", "long"), ("left", "long"))]
        crowded = scratch.write(head.select("head.*").mapInArrow(halve, schema).unionByName(late.select(*stretch[:-1], *none)))
        scratch.drop(crowd)
    dealt = cold.repartition("g", "w").sortWithinPartitions("g", "w", "_id", "_h", "_lo")
    ranked = [(scratch.write(dealt.mapInArrow(settle, schema)), False)] + ([(crowded, True)] if sizes["hot"] else [])
    every = ranked[0][0].unionByName(ranked[1][0]) if len(ranked) > 1 else ranked[0][0]
    pairs = scratch.write(every.where("_context is not null").select(F.explode(F.array("right", "left")).alias("r")).where("r is not null").groupBy("r").agg(F.count("*").alias("n")).where("n > 1").select("r"))
    # beyond FILTER ranks the filter would let nearly all pass, so all windows go on
    alive = spark.sparkContext.broadcast(bits_of(pairs, "r")) if halves and pairs.count() <= FILTER else None

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Round 3: the windows that hold a suffix whose 64-byte rank is shared, by their rank."""
        K.release()
        for batch in batches:
            for k in range(0, batch.num_rows, 5000):
                part = batch.slice(k, 5000)
                if not part.num_rows:
                    continue
                lo, hi, at, ids, sums = (np.asarray(part.column(c)) for c in ("_lo", "_hi", "_at", "_id", "_h"))
                short, begin = short_ranks(part.column("_context").to_pylist())
                row = np.repeat(np.arange(len(lo)), hi - lo + 1)
                p = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1)
                if alive is not None:
                    live = np.zeros(len(row), bool)
                    for side, start in (("right", at), ("left", at - GRAM)):
                        column = part.column(side)
                        open_ = np.asarray(column.is_valid()) & within(alive.value, np.asarray(column.fill_null(0)))
                        live |= open_[row] & (p <= start[row]) & (p + length >= start[row] + HALF)
                    row, p = row[live], p[live]
                name, other = (f(short, begin[row] + p - lo[row], length).view(np.int64) for f in (rank, second_name))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (name, other, ids[row], sums[row], p)], names=["name", "other", "_id", "_h", "_p"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of windows sorted by rank, those that are not the first of it."""
        K.release()
        state = Sorted(["name", "other"], ["_id", "_h", "_p"])
        for batch in batches:
            if batch.num_rows:
                late = batch.filter(pa.array(state.meet(batch)[1]))
                yield pa.RecordBatch.from_arrays([late.column(c) for c in ("_id", "_h", "_p", "_p")], names=["_id", "_h", "_lo", "_hi"])

    spans = every.where("_context is null").select("_id", "_h", "_lo", "_hi")
    for rows, crowded in ranked:
        some = rows.where("_context is not null")
        windows = some.mapInArrow(explode, "name long, other long, _id long, _h long, _p long")
        if crowded:
            head = windows.groupBy("name", "other").agg(F.min(F.struct("_id", "_h", "_p")).alias("head"), F.count("*").alias("n")).where("n > 1")
            late = windows.join(head, ["name", "other"]).where(F.struct("_id", "_h", "_p") > F.col("head")).select("_id", "_h", F.col("_p").alias("_lo"), F.col("_p").alias("_hi"))
        else:
            late = windows.repartition("name").sortWithinPartitions("name", "other", "_id", "_h", "_p").mapInArrow(repeated, "_id long, _h long, _lo long, _hi long")
        spans = spans.unionByName(late)
    return scratch, first, scratch.write(spans)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, as_text: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept_bytes or, as_text, kept_text (without characters that a cut has split).

    Columns of docs that clash with these names are replaced.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_text" if as_text else "kept_bytes"]
    _, first, spans = repeated_spans(docs, id_col, text_col, length)
    docs = docs.drop(*added)
    per = spans.groupBy("_id", "_h").agg(F.collect_list("_lo").alias("_lo"), F.collect_list("_hi").alias("_hi"))
    plan = first.join(per, ["_id", "_h"], "left").select("_id", "_h", F.lit(True).alias("_first"), "_lo", "_hi")
    keyed = docs.withColumns({"_id": F.col(id_col).cast("long"), "_h": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    joined = keyed.join(plan, ["_id", "_h"], "left").drop("_id", "_h")
    names = [c for c in docs.columns]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            for b in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                texts = [x.encode() for x in K.plain(b, text_col).to_pylist()]
                first, ids = b.column("_first").to_pylist(), b.column(id_col).to_pylist()
                los, his = b.column("_lo"), b.column("_hi")
                out = []
                for i, t in enumerate(texts):
                    n = len(t)
                    if n < length or ids[i] is None:
                        out.append((n, 0, 0, t))
                    elif not first[i]:  # a later copy of an equal text
                        out.append((n, n, 1, b""))
                    elif los[i].as_py() is None:
                        out.append((n, 0, 0, t))
                    else:
                        lo, hi = los[i].values.to_numpy(), his[i].values.to_numpy() + length
                        mark = np.zeros(n + 1, np.int64)
                        np.add.at(mark, lo, 1)
                        np.add.at(mark, hi, -1)
                        gone = np.cumsum(mark)[:n] > 0
                        starts = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                        out.append((n, int(gone.sum()), starts, np.frombuffer(t, np.uint8)[~gone].tobytes()))
                *numbers, kept = list(zip(*out)) if out else [[], [], [], []]
                kept = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(c, pa.int64()) for c in numbers] + [kept], names=names + added)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(cut, f"{schema}, n_bytes long, n_removed long, n_spans long, {added[-1]} {'string' if as_text else 'binary'}")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
