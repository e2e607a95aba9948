"""Vector kernels over the bytes of many texts at once (numpy, no per-word Python)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
SPACE_ALONE = np.arange(256) == 32
SLOTS = 22
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))
MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def release() -> None:
    """Give back the memory that earlier tasks of this worker have freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser; x is left as it is."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i < n."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for r in (_R, _RINV):
            a = np.empty(size, np.uint64)
            a[0] = 1
            a[1:] = np.uint64(r)
            out.append(np.multiply.accumulate(a))
        if n > 1 << 24:
            return out[0], out[1]
        _powers = (out[0], out[1])
    return _powers


class Texts:
    """Bytes of some texts laid end to end; start has one entry more than there are texts."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
        data = column.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = whole[offsets[0] : offsets[-1]]
        self.start = offsets - offsets[0]
        if column.null_count:  # a null may have bytes behind it
            keep = np.asarray(column.is_valid())
            parts = [self.bytes[a:b] if k else self.bytes[:0] for a, b, k in zip(self.start[:-1], self.start[1:], keep)]
            self.bytes = np.concatenate(parts) if parts else self.bytes
            self.start = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


class Words:
    """Words of Texts: begin and end (bytes), doc (index of the text), first (index of each text's first word)."""

    def __init__(self, texts: Texts, lower: bool = True, blank: np.ndarray = BLANK):
        raw = LOWER[texts.bytes] if lower else texts.bytes
        n, blank = len(raw), blank[raw]
        at = np.zeros(n + 1, bool)
        at[texts.start] = True
        gap = np.empty(n + 1, bool)
        gap[0] = True
        gap[1:] = blank
        gap |= at
        inside = ~blank
        self.bytes = raw
        self.begin = np.flatnonzero(inside & gap[:-1])
        after = np.ones(n + 1, bool)
        after[:-1] = blank | at[:-1]
        self.end = np.flatnonzero(inside & after[1:]) + 1
        self.first = np.searchsorted(self.begin, texts.start)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, most: int = 0) -> np.ndarray:
        """Of each word, or of its first `most` bytes."""
        end = np.minimum(self.end, self.begin + most) if most else self.end
        r, inverse = powers(len(self.bytes) + 1)
        total = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * r[: len(self.bytes)], out=total[1:])
        return mix((total[end] - total[self.begin]) * inverse[self.begin])

    def grams(self, h: np.ndarray, gaps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of word tuples at the given distances from their first word, and which firsts have all of them."""
        n, reach = len(h), gaps[-1]
        if n <= reach:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = np.full(n - reach, np.uint64(len(gaps) * 1000 + reach), np.uint64)
        for g, m in zip(gaps, MULT):
            out = (out + h[g : n - reach + g]) * m
            out ^= out >> np.uint64(29)
        whole = np.flatnonzero(self.doc[: n - reach] == self.doc[reach:])
        return mix(out[whole]), whole


def slices(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes; a longer text stands alone."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)) if len(column) else np.zeros(0)
    begin, total = 0, 0
    for i, s in enumerate(size.tolist()):
        if total + s > most and i > begin:
            yield begin, i
            begin, total = i, 0
        total += s
    if begin < len(size):
        yield begin, len(size)


def plain(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column without nulls."""
    return pa.compute.fill_null(batch.column(name).cast(pa.large_string()), "")


def loads(raw: np.ndarray) -> np.ndarray:
    """The 64-bit little-endian word that begins at every byte; raw ends with 8 spare bytes."""
    return np.ndarray((len(raw) - 8,), "<u8", np.ascontiguousarray(raw), strides=(1,))


def name32(raw: np.ndarray) -> np.ndarray:
    """A name of the 32 bytes from every position; raw ends with 32 spare bytes."""
    v = loads(np.concatenate([raw, np.zeros(8, np.uint8)]))
    n = len(raw) - 32
    out = v[:n] * MULT[0]
    for k in (1, 2, 3):
        out ^= out >> np.uint64(31)
        out += v[8 * k : n + 8 * k]
        out *= MULT[k]
    return mix(out)


class Memo:
    """Ids of words met lately, by the words' 64-bit hashes: a table of two places a word, a pool of ids and one of the words' bytes."""

    def __init__(self):
        self.key, self.word = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int32)
        self.clear()

    def clear(self) -> None:
        self.key[:] = 0
        self.n, self.used = 0, 0
        self.start, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.begin, self.text = np.zeros(1 << 16, np.int64), np.zeros(1 << 20, np.uint8)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.uint64((1 << SLOTS) - 1)
        return (h & low).astype(np.int64), (h >> np.uint64(SLOTS) & low).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Word numbers, -1 where unknown."""
        a, b = self.places(h)
        return np.where(self.key[a] == h, self.word[a], np.where(self.key[b] == h, self.word[b], -1))

    def add(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Numbers of new words, whose ids lie end to end."""
        while self.n + len(h) + 1 > len(self.start):
            self.start, self.begin = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.begin))
        letters = np.frombuffer(b"".join(words), np.uint8)
        top = int(self.begin[self.n])
        while top + len(letters) + 8 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.text[top : top + len(letters)] = letters
        self.begin[self.n + 1 : self.n + len(h) + 1] = top + np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        while self.used + int(size.sum()) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + int(size.sum())] = ids
        self.start[self.n + 1 : self.n + len(h) + 1] = self.used + np.cumsum(size)
        number = np.arange(self.n, self.n + len(h))
        self.n, self.used = self.n + len(h), self.used + int(size.sum())
        a, b = self.places(h)
        at = np.where((self.key[a] == 0) | (self.key[b] != 0), a, b)
        self.key[at], self.word[at] = h, number
        return number

    def differ(self, words: Words, own: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether each of some words has other bytes than the known word of its number: eight bytes at a time, very long words by themselves."""
        a, b, c = words.begin[own], words.end[own], self.begin[number]
        size = b - a
        out = self.begin[number + 1] - c != size
        mine, known = loads(np.concatenate([words.bytes, np.zeros(8, np.uint8)])), loads(self.text)
        left = np.flatnonzero(~out)
        for k in range(0, 256, 8):
            rest = size[left] - k
            x = (mine[a[left] + k] ^ known[c[left] + k]) << (64 - 8 * np.minimum(rest, 8)).astype(np.uint64)
            out[left[x != 0]] = True
            left = left[(x == 0) & (rest > 8)]
            if not len(left):
                return out
        for i in left.tolist():
            out[i] = not np.array_equal(words.bytes[a[i] : b[i]], self.text[c[i] : c[i] + size[i]])
        return out

    def ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words end to end, and where each word begins (one more than words)."""
        size = self.start[number + 1] - self.start[number]
        end = np.cumsum(size)
        first = np.concatenate([[0], end])
        at = np.repeat(self.start[number] - first[:-1], size) + np.arange(int(first[-1]))
        return self.pool[at], first
