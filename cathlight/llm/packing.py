"""Packing of token sequences by lexical retrieval (operator 6).

A text is tokenised whole and ends with END_ID. Its full windows are sequences by themselves. The BM25
statistics (document frequency of each token id, number and mean length) are those of all tails that
are left. A tail is routed by two of its tokens, each drawn with its idf as weight by a hash that all tails
share, so tails that share rare tokens, copies above all, tend to stand side by side; that order
is dealt into shards of about SHARD tails by Spark's range partitioning, which parts equal routes by content.
Each shard is indexed by term. A seed takes its window; the unused tails that score best for all of the
seed's tokens follow until the window is full, the last one is cut there, and what is left of
it is the next seed. If no neighbour is left, the next unused tail follows. Only the last window of
a shard is short; it is cut into sequences whose lengths are powers of two, so nothing is padded.

Null and empty texts are END_ID alone. A null id is packed under a null id, repeated rows are packed
each by themselves. Other columns are not part of the result. Tokens are written and counted while the
result is planned.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, table

WINDOW, END_ID, SHARD = 1024, 0, 2048
K1, B = 1.2, 0.75
STEP, CELLS = 2.0**-36, 1 << 24
MEMO = 1_500_000
PLAIN = re.compile("[ ]?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+|[!-/:-@\\[-`{-~]+)")
_codes = np.arange(256)
LETTER = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
SIGN = (_codes > 32) & (_codes < 127) & ~LETTER
LATIN = (_codes >= 0xC3) & (_codes <= 0xC5)  # first bytes of U+00C0 to U+017F
ALPHABET = _codes.astype("<u4")  # of byte-level tokenizers: printable bytes are themselves, the others count from 256
ALPHABET[(_codes < 33) | (_codes > 126) & (_codes < 161) | (_codes == 173)] = np.arange(256, 256 + 68)
ALPHABET[10] = 10  # but for ends of lines, which part words here
_memos: dict[str, K.Memo] = {}
_tokenizers: dict[str, tuple] = {}


def tokenizer(path: str):
    """The tokenizer, which ids begin with a space, and its merges alone, for lines of the alphabet of bytes."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        coder = Tokenizer.from_file(path)
        spaced = np.zeros(coder.get_vocab_size(), bool)
        spaced[[i for t, i in coder.get_vocab().items() if t.startswith("\u0120")]] = True
        merges = Tokenizer.from_file(path)
        merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        _tokenizers[path] = coder, spaced, merges
    return _tokenizers[path]


def odd_spacing(texts: K.Texts) -> np.ndarray:
    """Texts with white space side by side or at an end, or with any beyond ASCII."""
    raw, start = texts.bytes, texts.start
    blank = K.BLANK[raw]
    bad = np.zeros(len(raw) + 1, bool)
    bad[1:-1] = blank[1:] & blank[:-1]
    lead = np.flatnonzero((raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3))
    if len(lead):
        padded = np.concatenate([raw, np.zeros(2, np.uint8)])
        a, b, c = raw[lead], padded[lead + 1], padded[lead + 2]
        # White space of Unicode beyond ASCII
        wide = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        wide |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
        bad[lead[wide]] = True
    size = np.diff(start)
    some = np.flatnonzero(size)
    bad[start[:-1][some]] |= blank[start[:-1][some]]
    bad[start[1:][some] - 1] |= blank[start[1:][some] - 1]
    out = np.zeros(len(size), bool)
    if len(some):
        out[some] = np.logical_or.reduceat(bad[:-1], start[:-1][some])
    return out


class Parts(K.Words):
    """Parts of texts that the tokenizer never joins, in texts whose white space stands alone.

    One begins at each space, before and after each end of a line, and at an ASCII sign after an ASCII
    letter or digit or a Latin letter of two bytes.
    """

    def __init__(self, texts: K.Texts):
        raw = self.bytes = texts.bytes
        line, ends = raw == 10, LETTER[raw]
        ends[1:] |= LATIN[raw[:-1]] & ~((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)))  # not the signs of multiplication and division
        cut = np.zeros(len(raw) + 1, bool)
        cut[:-1] = (raw == 32) | line
        cut[1:] |= line
        cut[1:-1] |= ends[:-1] & SIGN[raw[1:]]
        cut[texts.start] = True
        self.begin = np.flatnonzero(cut[:-1])
        self.end = np.append(self.begin[1:], len(raw))
        self.first = np.searchsorted(self.begin, texts.start)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)


def encode_parts(parts: list[str], path: str) -> list[bytes]:
    """The ids of each part, many at a time.

    Letters alone and signs alone, with or without a space before them, are not cut further by the tokenizer:
    they go to its merges in the alphabet of bytes, with a carriage return, which none of them holds, between two.
    Others that begin with a space go to the tokenizer in one text, cut where a token begins with a space.
    """
    coder, spaced, merges = tokenizer(path)
    plain = [PLAIN.fullmatch(p) is not None for p in parts]
    out = [b""] * len(parts)

    def keep(group: list[int], ids: np.ndarray, first: np.ndarray) -> None:
        raw, cut = ids.tobytes(), [*(4 * first).tolist(), 4 * len(ids)]
        for i, a, b in zip(group, cut[:-1], cut[1:]):
            out[i] = raw[a:b]

    def groups(own: list[int]) -> list[list[int]]:
        return [own[a : a + 256] for a in range(0, len(own), 256)]

    some = groups([i for i, p in enumerate(plain) if p])
    lines = [ALPHABET[np.frombuffer("\n\r\n".join([parts[i] for i in g]).encode(), np.uint8)].tobytes().decode("utf-32-le") for g in some]
    stop = coder.token_to_id(chr(ALPHABET[13]))
    for g, found in zip(some, merges.encode_batch_fast(lines, add_special_tokens=False)):
        ids = np.array(found.ids, "<u4")
        at = np.flatnonzero(ids == stop)
        keep(g, np.delete(ids, at), np.concatenate([[0], at - np.arange(len(at))]))
    alone = [i for i, p in enumerate(plain) if not p and parts[i][0] != " "]
    some = groups([i for i, p in enumerate(plain) if not p and parts[i][0] == " "])
    for g, found in zip(some, coder.encode_batch_fast(["".join([parts[i] for i in g]) for g in some], add_special_tokens=False)):
        ids = np.array(found.ids, "<u4")
        first = np.flatnonzero(spaced[ids])
        if len(first) == len(g):
            keep(g, ids, first)
        else:
            alone += g
    for i, found in zip(alone, coder.encode_batch_fast([parts[i] for i in alone], add_special_tokens=False)):
        out[i] = np.array(found.ids, "<u4").tobytes()
    return out


def encode(column: pa.Array, path: str) -> list[bytes]:
    """The ids (32-bit, little-endian) of each text.

    The tokenizer cuts a text between its Parts whatever surrounds them, so parts are encoded once and
    remembered; a text with white space side by side, at an end or beyond ASCII, with a special token, or with a part
    whose hash is another part's, is encoded whole.
    """
    coder = tokenizer(path)[0]
    if path not in _memos:
        _memos[path] = K.Memo()
    memo = _memos[path]
    if memo.n > MEMO:
        memo.clear()
    texts = K.Texts(column)
    whole = odd_spacing(texts)
    for token in coder.get_added_tokens_decoder().values():
        whole |= np.asarray(pa.compute.match_substring(column, token.content))
    parts = Parts(texts)
    own = np.flatnonzero(~whole[parts.doc])
    h = parts.hashes()[own] | np.uint64(1)
    number = memo.find(h).astype(np.int64)
    miss = np.flatnonzero(number < 0)
    if len(miss):
        new, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
        raw = texts.bytes.tobytes()
        at = own[miss[first]]
        fresh = [raw[a:b] for a, b in zip(parts.begin[at].tolist(), parts.end[at].tolist())]
        coded = encode_parts([p.decode() for p in fresh], path)
        number[miss] = memo.add(new, np.frombuffer(b"".join(coded), "<u4"), np.fromiter(map(len, coded), np.int64, len(coded)) // 4, fresh)[inverse]
    clash = memo.differ(parts, own, number)  # parts that share a hash with another part
    if clash.any():
        whole[parts.doc[own[clash]]] = True
        kept = ~whole[parts.doc[own]]
        own, number = own[kept], number[kept]
    ids, begin = memo.ids(number)
    raw_ids, cut = ids.tobytes(), (4 * begin[np.searchsorted(own, parts.first)]).tolist()
    out = [raw_ids[a:b] for a, b in zip(cut[:-1], cut[1:])]
    some = np.flatnonzero(whole)
    for i, found in zip(some.tolist(), coder.encode_batch_fast(column.take(pa.array(some)).to_pylist(), add_special_tokens=False)):
        out[i] = np.array(found.ids, "<u4").tobytes()
    return out


class Corpus:
    """Number and mean length of all tails, and the idf of each token id."""

    def __init__(self, n: int, total: int, df: np.ndarray):
        self.mean = total / max(n, 1)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)) * (df > 0)
        ids = np.arange(len(df), dtype=np.uint64)
        draw = lambda m: -np.log((K.mix(ids * K.MULT[m] + K.MULT[m + 1]) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) / np.maximum(self.idf, 1e-9)
        self.draws = np.argsort(np.argsort(draw(0))).astype(np.int64), np.argsort(np.argsort(draw(2))).astype(np.int64)

    def route(self, tail: np.ndarray) -> int:
        """The token that comes first in each of two orders of all tokens, in which rare ones tend to come first."""
        return int(self.draws[0][tail].min()) << 32 | int(self.draws[1][tail].min())


class Shard:
    """BM25 over the tails of one shard; retrieve() sees the unused ones only.

    Tokens of more than an eighth of the tails are weighed for all tails at once, by products of
    matrices; the others are read from their lists. Weights are whole multiples of STEP, so sums of up
    to 2^11 of them are exact, whatever the order in which they are added.
    """

    def __init__(self, tails: list[np.ndarray], corpus: Corpus):
        n = len(tails)
        size = np.array([len(t) for t in tails], np.int64)
        key, tf = np.unique(np.concatenate(tails).astype(np.int64) * n + np.repeat(np.arange(n), size), return_counts=True)
        term, doc = key // n, key % n
        weight = corpus.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (size / corpus.mean)[doc]))
        weight = np.ceil(weight / STEP) * STEP
        df = np.bincount(term)
        often = df > max(n // 8, 32)
        self.column = np.where(often, np.cumsum(often) - 1, -1)  # of a frequent token
        some = often[term]
        self.common = np.zeros((int(often.sum()), n))
        self.common[self.column[term[some]], doc[some]] = weight[some]
        self.doc, self.weight = doc[~some], weight[~some]
        self.first = np.concatenate([[0], np.cumsum(np.where(often, 0, df))])
        self.n, self.unused = n, np.ones(n, bool)
        self.shared = np.zeros((min(n, CELLS // n), n))  # scores by frequent tokens of the first tails, all of them in a shard of the usual size
        for c in range(0, len(self.common), 512):
            own = self.common[c : c + 512]
            self.shared += (own[:, : len(self.shared)] > 0).T.astype(float) @ own

    def score(self, query: np.ndarray, tail: int | None = None) -> np.ndarray:
        """Of each tail for a query, which may be a tail of the shard."""
        terms = np.unique(query)
        a, b = self.first[terms], self.first[terms + 1]
        a, size = a[b > a], (b - a)[b > a]
        at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        out = np.bincount(self.doc[at], self.weight[at], self.n)
        if tail is not None and tail < len(self.shared):
            return out + self.shared[tail]
        column = self.column[terms]
        return out + self.common[column[column >= 0]].sum(axis=0)

    def best(self, score: np.ndarray) -> Iterator[int]:
        """The tails unused by now that share a token with the query, best first, equal ones in the shard's order; sorted 64 at a time."""
        found = np.flatnonzero((score > 0) & self.unused)
        while len(found):
            own = score[found]
            top = own >= np.partition(own, -64)[-64] if len(own) > 64 else np.ones(len(own), bool)
            yield from found[top][np.argsort(-own[top], kind="stable")].tolist()
            found = found[~top]

    def retrieve(self, query: np.ndarray) -> np.ndarray:
        return np.fromiter(self.best(self.score(query)), np.int64)


def pack_shard(tails: list[np.ndarray], corpus: Corpus, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(tail, from, length, sequence, offset) of every piece."""
    shard, n = Shard(tails, corpus), len(tails)
    after = 0  # the first tail that may be unused
    sequence, left = 0, None  # left: (tail, from) of the tail that was cut
    while left or after < n:
        if left is None:
            while after < n and not shard.unused[after]:
                after += 1
            if after == n:
                break
            shard.unused[after] = False
            left = (after, 0)
        seed, begin = left
        left, room, parts = None, window, []

        def put(t: int, start: int) -> tuple[int, int] | None:
            nonlocal room
            take = min(room, len(tails[t]) - start)
            parts.append((t, start, take, window - room))
            room -= take
            return (t, start + take) if start + take < len(tails[t]) else None

        left = put(seed, begin)
        if room:
            for t in shard.best(shard.score(tails[seed], seed)):
                shard.unused[t] = False
                left = put(t, 0)
                if not room:
                    break
        while room:
            while after < n and not shard.unused[after]:
                after += 1
            if after == n:
                break
            shard.unused[after] = False
            left = put(after, 0)
        if not room:
            yield from ((t, s, m, sequence, o) for t, s, m, o in parts)
            sequence += 1
            continue
        total, at = window - room, 0  # the last window: one sequence for each bit of its length
        for bit in reversed(range(total.bit_length())):
            if total >> bit & 1:
                end = at + (1 << bit)
                for t, s, m, o in parts:
                    lo, hi = max(o, at), min(o + m, end)
                    if lo < hi:
                        yield t, s + lo - o, hi - lo, sequence, lo - at
                sequence, at = sequence + 1, end


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if with_ids, ids (32-bit little-endian)."""
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    end = np.array([END_ID], "<u4").tobytes()
    names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [pa.int64()] * 7 + [pa.binary()]
    schema = "_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=names)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Full windows as pieces; tails with a null sequence and their ids."""
        K.release()
        task, made = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            column, ids = K.plain(batch, "_text"), batch.column("_id").to_pylist()
            for i, j in K.slices(column):
                rows = []
                for d, raw in zip(ids[i:j], encode(column[i:j], path)):
                    raw += end
                    n = len(raw) // 4
                    whole = n - n % window
                    for s in range(0, whole, window):
                        piece = raw[4 * s : 4 * (s + window)]
                        rows.append((d, s, window, zlib.crc32(piece), n, 2 * (task + made) + 1, 0, piece if with_ids else None))
                        made += 1
                    if n > whole:
                        rows.append((d, whole, n - whole, None, n, None, None, raw[4 * whole :]))
                yield batch_of(rows)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many tails hold each token id; -1: tails, -2: their tokens."""
        K.release()
        df, last, n, total = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64), 0, 0
        for batch in batches:
            for raw in batch.column("ids").to_pylist():
                ids = np.frombuffer(raw, "<u4")
                at = np.arange(len(ids))
                last[ids] = at
                df[ids[last[ids] == at]] += 1  # each id once
                n, total = n + 1, total + len(ids)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some])), pa.array(np.concatenate([[n, total], df[some]]))], names=["k", "n"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        corpus = shared.value
        for batch in batches:
            to = [corpus.route(np.frombuffer(raw, "<u4")) for raw in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.int64())], names=[*batch.schema.names, "route"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pieces of one shard, which is a partition."""
        K.release()
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        group = pa.Table.from_batches(parts)
        raw = group.column("ids").to_pylist()
        tails = [np.frombuffer(r, "<u4").astype(np.int64) for r in raw]
        ids, start, n = (group.column(c).to_pylist() for c in ("_id", "start", "doc_tokens"))
        key, rows = TaskContext.get().partitionId() << 32, []
        for t, s, m, sequence, offset in pack_shard(tails, shared.value, window):
            piece = raw[t][4 * s : 4 * (s + m)]
            rows.append((ids[t], start[t] + s, m, zlib.crc32(piece), n[t], 2 * (key + sequence), offset, piece if with_ids else None))
        yield batch_of(rows)

    vocabulary = tokenizer(path)[0].get_vocab_size()
    spark = docs.sparkSession
    made = Scratch(spark, "pack").write(own.mapInArrow(tokens, schema))
    tails = made.where("sequence_id is null").select("_id", "start", "doc_tokens", "ids")
    counts = {r.k: r.n for r in tails.select("ids").mapInArrow(frequency, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}  # at most one for each token id
    n, total = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(vocabulary, np.int64)
    df[list(counts)] = list(counts.values())
    shared = spark.sparkContext.broadcast(Corpus(n, total, df))
    routed = tails.mapInArrow(route, "_id long, start long, doc_tokens long, ids binary, route long").withColumns({"h": F.xxhash64("_id", "ids"), "u": F.monotonically_increasing_id()})  # u parts repeated rows
    dealt = routed.repartitionByRange(max(1, -(-n // SHARD)), "route", "h", "u").sortWithinPartitions("route", "h", "_id", "start", "ids")
    packed = dealt.select("_id", "start", "doc_tokens", "ids").mapInArrow(fill, schema)
    out = made.where("sequence_id is not null").unionByName(packed).withColumnRenamed("_id", id_col)
    return out if with_ids else out.drop("ids")


def op6_retrieval_packing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
