"""SentencePiece encoding and decoding by suffix-array matching (operator 1).

The model file is read as it is: pieces, scores, kinds and the normaliser's switches. Texts of a batch
are cut where no piece can cross (before a space mark that follows another character); of the cuts
not met lately the bytes are laid end to end and indexed by a suffix array (prefix doubling). Every
piece is searched in it, and its range of suffixes gives its occurrences: edges from byte to byte.
Edges sorted by position are then relaxed: for a unigram model the best path from left to right; for
a BPE model, whose result is not a best path, in the order of its merges: the edge of the best score
that joins two neighbours, the leftmost of equals, until none is left. What no edge covers becomes
byte pieces, or the unknown piece.

Null and empty texts have no ids. Columns that clash with the added ones are replaced, others kept.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import table

SPACE = "▁"
MARK = SPACE.encode()
LONG, CHUNK, MEMO = 96, 1 << 18, 1_000_000
# Kinds of pieces in a model file
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out, shift = 0, 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value, at = raw[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = raw[at : at + n], at + n
        yield tag >> 3, value


class Model:
    def __init__(self, path: str):
        self.pieces: list[bytes] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.bpe, self.prefix, self.squeeze = False, True, True
        with open(path, "rb") as f:
            raw = f.read()
        for number, value in fields(raw):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece.get(1, b""))
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                kind = dict(fields(value)).get(3, 1)
                if kind not in (1, 2):
                    raise ValueError("only unigram and BPE models are known")
                self.bpe = kind == 2
            elif number == 3:
                switches = dict(fields(value))
                if switches.get(2):
                    raise ValueError("models with a character map are not known")
                self.prefix, self.squeeze = bool(switches.get(3, 1)), bool(switches.get(4, 1))
        kinds = np.array(self.kinds)
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        usable = np.flatnonzero((kinds == NORMAL) | (kinds == USER))
        usable = usable[[bool(self.pieces[i]) for i in usable]]
        self.ids = usable
        self.size = np.array([len(self.pieces[i]) for i in usable], np.int64)
        self.longest = int(self.size.max())
        words = -(-self.longest // 8)
        self.key, self.mask = np.zeros((words, len(usable)), np.uint64), np.zeros((words, len(usable)), np.uint64)
        for w in range(words):
            for j, i in enumerate(usable):
                part = self.pieces[i][8 * w : 8 * w + 8]
                self.key[w, j] = int.from_bytes(part.ljust(8, b"\0"), "big")
                self.mask[w, j] = int.from_bytes((b"\xff" * len(part)).ljust(8, b"\0"), "big")
        score = np.array(self.scores)[usable]
        order = np.argsort(-score, kind="stable")
        self.rank = np.empty(len(usable), np.int64)  # equal scores share a rank
        fresh = np.append(False, np.diff(score[order]) != 0)
        self.rank[order] = np.cumsum(fresh)
        self.score = score
        inside = [i for i in usable if any(self.pieces[i].decode("utf-8", "replace")[k] != SPACE and c == SPACE for k, c in enumerate(self.pieces[i].decode("utf-8", "replace")[1:]))]
        self.separable = not inside
        plain = [SPACE_BYTES if k == UNKNOWN else b"" if k in (CONTROL, UNUSED) else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, b" ") for p, k in zip(self.pieces, self.kinds)]
        self.plain_start = np.concatenate([[0], np.cumsum([len(x) for x in plain])])
        self.plain = np.frombuffer(b"".join(plain), np.uint8)

    def normal(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def cuts(self, text: str) -> list[str]:
        """The parts of a normalised text between which no piece can lie."""
        if not self.separable or not text:
            return [text] if text else []
        parts = text.split(SPACE)
        head, tail = parts[0], parts[1:]
        if "" not in tail:
            out = [SPACE + p for p in tail]
        else:
            out, marks = [], ""
            for p in tail:
                marks += SPACE
                if p:
                    out.append(marks + p)
                    marks = ""
            if marks:
                out.append(marks)
        return [head, *out] if head else out

    def decode(self, ids: np.ndarray, cut: np.ndarray) -> list[str]:
        """The texts of ids that lie end to end; cut has the beginning of each and the end."""
        size = self.plain_start[ids + 1] - self.plain_start[ids]
        first = np.concatenate([[0], np.cumsum(size)])
        raw = self.plain[np.repeat(self.plain_start[ids] - first[:-1], size) + np.arange(int(first[-1]))].tobytes()
        at = first[cut].tolist()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
        return [t[1:] if t[:1] == " " else t for t in texts] if self.prefix else texts


SPACE_BYTES = " ⁇ ".encode()


def suffix_array(raw: np.ndarray, reach: int) -> np.ndarray:
    """Suffixes of raw by their first `reach` bytes or more: ranks of 8 bytes, doubled."""
    n = len(raw)
    rank = np.unique(K.loads(np.concatenate([raw, np.zeros(8, np.uint8)])).byteswap(), return_inverse=True)[1].astype(np.int64) + 1
    width = 8
    while width < reach and rank.max() < n:  # until unique, or past the longest piece
        after = np.zeros(n, np.int64)
        if width < n:
            after[:-width] = rank[width:]
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        width *= 2
    return np.argsort(rank)


def edges(model: Model, raw: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin * 64 + length, piece) of all occurrences that end by stop[begin], sorted."""
    order = suffix_array(raw, model.longest)
    padded = np.concatenate([raw, np.zeros(8 * len(model.key) + 8, np.uint8)])
    loads = K.loads(padded).byteswap()
    bounds = []
    for upper in (False, True):
        lo, hi = np.zeros(len(model.ids), np.int64), np.full(len(model.ids), len(order), np.int64)
        while (lo < hi).any():
            middle = (lo + hi) >> 1
            at = order[np.minimum(middle, len(order) - 1)]
            less, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for w in range(len(model.key)):
                live = np.flatnonzero(equal & (model.mask[w] > 0))
                if not len(live):
                    break
                x = loads[at[live] + 8 * w] & model.mask[w, live]
                less[live] |= x < model.key[w, live]
                equal[live] &= x == model.key[w, live]
            right = less | equal if upper else less
            open_ = lo < hi
            lo = np.where(open_ & right, middle + 1, lo)
            hi = np.where(open_ & ~right, middle, hi)
        bounds.append(lo)
    count = bounds[1] - bounds[0]
    piece = np.repeat(np.arange(len(count)), count)
    at = order[np.repeat(bounds[0] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
    fits = at + model.size[piece] <= stop[at]
    key = at[fits] * 64 + model.size[piece[fits]] if model.longest < 64 else at[fits] * 4096 + model.size[piece[fits]]
    by = np.argsort(key)
    return key[by], piece[fits][by]


def encode_units(model: Model, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the parts end to end and how many each has, through one suffix array."""
    coded = [u.encode() for u in units]
    size = np.fromiter(map(len, coded), np.int64, len(coded))
    raw = np.frombuffer(b"".join(coded), np.uint8)
    end = np.cumsum(size)
    key, piece = edges(model, raw, np.repeat(end, size))
    width = 64 if model.longest < 64 else 4096
    begin = np.flatnonzero((raw & 0xC0) != 0x80)  # characters
    length = np.diff(np.append(begin, len(raw)))
    unit = np.searchsorted(end, begin, "right")
    if model.bpe:
        chars = np.bincount(unit, minlength=len(units))
        short = chars[unit] <= LONG
        done = [merge_all(model, begin[short], length[short], unit[short], key, piece, width)]
        for u in np.flatnonzero(chars > LONG):
            own = slice(*np.searchsorted(unit, [u, u + 1]))
            done.append(merge_long(model, begin[own], length[own], key, piece, width))
        begin, length = (np.concatenate(x) for x in zip(*done))
        by = np.argsort(begin, kind="stable")
        begin, length = begin[by], length[by]
    else:
        begin, length = best_paths(model, begin, length, unit, key, piece, width)
    at = np.minimum(np.searchsorted(key, begin * width + length), max(len(key) - 1, 0))
    known = key[at] == begin * width + length if len(key) else np.zeros(len(begin), bool)
    ids = np.where(known, model.ids[piece[at]] if len(key) else 0, -1)
    owner = np.searchsorted(end, begin, "right")
    if known.all():
        return ids, np.bincount(owner, minlength=len(units))
    if len(model.byte_id) == 256:
        count = np.where(known, 1, length)
        flat, step = np.repeat(ids, count), np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        raw_at = np.flatnonzero(flat < 0)
        table = np.array([model.byte_id[b] for b in range(256)])
        flat[raw_at] = table[raw[(np.repeat(begin, count) + step)[raw_at]]]
        return flat, np.bincount(owner, count, len(units)).astype(np.int64)
    out: list[int] = []
    size = np.zeros(len(units), np.int64)
    listed = ids.tolist()
    for i, u in enumerate(owner.tolist()):
        before = len(out)
        if listed[i] >= 0:
            out.append(listed[i])
        elif not (i and owner[i - 1] == u and listed[i - 1] < 0):  # unknown neighbours are one
            out.append(model.unknown)
        size[u] += len(out) - before
    return np.array(out, np.int64), size


def merge_all(model, begin, length, unit, key, piece, width) -> tuple[np.ndarray, np.ndarray]:
    """All parts at once: in each round the best edge of every part joins its two neighbours."""
    out_begin, out_length = [], []
    rank = model.rank[piece]
    none = np.int64(1) << 60
    while len(begin):
        n = len(begin)
        both = np.full(n, none)
        if n > 1 and len(key):
            pair = np.flatnonzero((unit[1:] == unit[:-1]) & (length[1:] + length[:-1] < width))
            want = begin[pair] * width + length[pair] + length[pair + 1]
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = key[at] == want
            both[pair[hit]] = rank[at[hit]] << 32 | pair[hit]
        first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        least = np.minimum.reduceat(both, first)
        live = least < none
        if not live.all():
            over = np.repeat(~live, np.diff(np.append(first, n)))
            out_begin.append(begin[over])
            out_length.append(length[over])
        join = least[live] & 0xFFFFFFFF
        length = length.copy()
        length[join] += length[join + 1]
        keep = np.repeat(live, np.diff(np.append(first, n)))
        keep[join + 1] = False
        begin, length, unit = begin[keep], length[keep], unit[keep]
    return np.concatenate(out_begin or [begin]), np.concatenate(out_length or [length])


def merge_long(model, begin, length, key, piece, width) -> tuple[np.ndarray, np.ndarray]:
    """One long part, by a heap of edges."""
    n = len(begin)
    a, b = np.searchsorted(key, [begin[0] * width, (begin[-1] + 1) * width])
    rank = dict(zip(key[a:b].tolist(), model.rank[piece[a:b]].tolist()))
    start, size = begin.tolist(), length.tolist()
    after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and size[i] + size[j] < width:
            r = rank.get(start[i] * width + size[i] + size[j])
            if r is not None:
                heapq.heappush(heap, (r, i, size[i], size[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, x, y = heapq.heappop(heap)
        j = after[i]
        if size[i] != x or j < 0 or size[j] != y:
            continue
        size[i], size[j] = x + y, 0
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    own = np.array([s > 0 for s in size])
    return begin[own], np.array(size)[own]


def best_paths(model, begin, length, unit, key, piece, width) -> tuple[np.ndarray, np.ndarray]:
    """The path of greatest total score through each part; a character without an edge costs the least score less 10."""
    penalty = float(model.score.min()) - 10.0
    score = model.score[piece].tolist()
    first = np.searchsorted(key, begin * width).tolist() + [len(key)]
    keys = key.tolist()
    start, size, part = begin.tolist(), length.tolist(), unit.tolist()
    best: dict[int, tuple[float, int]] = {}
    out: list[tuple[int, int]] = []
    for i, p in enumerate(start):
        if i == 0 or part[i] != part[i - 1]:
            best[p] = (0.0, -1)
        own = best[p][0]
        single = False
        for e in range(first[i], first[i + 1]):
            n = keys[e] - p * width
            single |= n == size[i]
            if p + n not in best or own + score[e] > best[p + n][0]:
                best[p + n] = (own + score[e], p)
        if not single and (p + size[i] not in best or own + penalty > best[p + size[i]][0]):
            best[p + size[i]] = (own + penalty, p)
        if i + 1 == len(start) or part[i + 1] != part[i]:
            at, back = p + size[i], []
            while best[at][1] >= 0:
                back.append((best[at][1], at - best[at][1]))
                at = best[at][1]
            out += reversed(back)
            best = {}
    got = np.array(out, np.int64).reshape(-1, 2)
    return got[:, 0], got[:, 1]


_models: dict[str, Model] = {}
_memos: dict[str, K.Memo] = {}


def model_of(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode_new(model: Model, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """encode_units() in chunks of about CHUNK bytes."""
    ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cut = np.cumsum([len(u) + 2 for u in units]) // CHUNK if units else np.zeros(0)
    for chunk in np.split(np.arange(len(units)), np.flatnonzero(np.diff(cut)) + 1):
        if len(chunk):
            x, n = encode_units(model, units[chunk[0] : chunk[-1] + 1])
            ids.append(x)
            sizes.append(n)
    return np.concatenate(ids), np.concatenate(sizes)


def encode_column(path: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and where each text begins in them (one more than texts).

    Where spaces stand alone between other characters, the parts are the words between them, each
    after a space mark; words met lately are known by a 64-bit hash. Other texts are cut in Python.
    """
    model = model_of(path)
    if path not in _memos:
        _memos[path] = K.Memo()
    memo = _memos[path]
    if memo.n > MEMO:
        memo.clear()
    texts = K.Texts(column)
    raw, start = texts.bytes, texts.start
    words = K.Words(texts, lower=False, blank=K.SPACE_ALONE)
    space = raw == 32
    odd = np.zeros(len(start) - 1, bool)
    strange = np.flatnonzero(space[1:] & space[:-1])
    if len(raw) > 2:
        strange = np.concatenate([strange, np.flatnonzero((raw[:-2] == MARK[0]) & (raw[1:-1] == MARK[1]) & (raw[2:] == MARK[2]))])
    odd[np.searchsorted(start, strange, "right") - 1] = True
    some = np.flatnonzero(np.diff(start))
    odd[some] |= space[start[:-1][some]] | space[start[1:][some] - 1]
    if not (model.separable and model.prefix):
        odd[:] = True
    own = np.flatnonzero(~odd[words.doc])
    h = words.hashes()[own] | np.uint64(1)
    number = memo.find(h).astype(np.int64)
    miss = np.flatnonzero(number < 0)
    if len(miss):
        new, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
        data, at = raw.tobytes(), own[miss[first]]
        fresh = [data[a:b] for a, b in zip(words.begin[at].tolist(), words.end[at].tolist())]
        ids, size = encode_new(model, [SPACE + w.decode() for w in fresh])
        number[miss] = memo.add(new, ids, size, fresh)[inverse]
    clash = memo.differ(words, own, number)  # words that share a hash with another word; their texts are encoded by parts
    if clash.any():
        odd[words.doc[own[clash]]] = True
        kept = ~odd[words.doc[own]]
        own, number = own[kept], number[kept]
    ids, begin = memo.ids(number)
    cut = begin[np.searchsorted(own, words.first)]
    if not odd.any():
        return ids, cut
    strings = column.filter(pa.array(odd)).to_pylist()
    parts = [model.cuts(model.normal(t)) for t in strings]
    units = sorted(set().union(*parts))
    coded, size = encode_new(model, units)
    place = dict(zip(units, np.split(coded, np.cumsum(size)[:-1]))) if units else {}
    lists = iter([np.concatenate([np.zeros(0, np.int64), *(place[u] for u in p)]) for p in parts])
    rows = [next(lists) if o else ids[a:b] for o, a, b in zip(odd.tolist(), cut[:-1].tolist(), cut[1:].tolist())]
    return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def _over(docs: DataFrame, kinds: dict[str, str], function) -> DataFrame:
    docs = docs.drop(*kinds)
    names = [*docs.columns, *kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, *function(part)], names=names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{n}` {k}" for n, k in kinds.items()])
    return docs.mapInArrow(run, schema)


def sp_encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """docs with ids, array<int>, and, if decoded_col is named, the text decoded from them in the same pass."""

    def ids(part: pa.RecordBatch) -> list[pa.Array]:
        got, cut = encode_column(path, K.plain(part, text_col))
        out = [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(got.astype(np.int32)))]
        return out + [pa.array(model_of(path).decode(got.astype(np.int64), cut), pa.string())] if decoded_col else out

    return _over(docs, {ids_col: "array<int>"} | ({decoded_col: "string"} if decoded_col else {}), ids)


def sp_decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with the text of ids; null ids give an empty text."""

    def texts(part: pa.RecordBatch) -> list[pa.Array]:
        column = part.column(ids_col)
        size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
        return [pa.array(model_of(path).decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(size)])), pa.string())]

    return _over(docs, {text_col: "string"}, texts)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sp_encode(docs, path, decoded_col="decoded")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
