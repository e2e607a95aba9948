"""Conversation structure repair by a lazily determinised weighted automaton (operator 12).

A conversation's rows, by turn (nulls first; rows of one turn by role, then by the SHA-256 of role and text), are edited at
least cost until their role initials read `(s?(ua)+)?`: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an empty user or
assistant row anywhere 5, and 5 more for a truncated row that is not deleted. Blank and duplicate rows have to be deleted.

The weighted automaton has the four states of that expression; its arcs are the edits. It is determinised while it is used: the
costs that remain from each of the four states, less their least, are one state of the deterministic automaton, and the step from
such a vector over a kind of row (role initial and fault: nine kinds) is computed once a Python worker and kept in the transition
table. Since an insertion closes every gap between the four costs, there are few vectors. The scan runs from the last row to the first and
only looks up the table: the sums of what was taken off are the cost. The trace goes back along the scan, from the first row to
the last, over the arcs that are tight (cost of the arc and what remains after it equal what remained before), with all states that the
least string so far can be in, and always takes the least letter: so its audit is the ASCII-least of the cheapest ones. Keep,
Rerole and Delete take one row each, so that string alone says what becomes of every row; its number of rows says their roles.

Faults need the first row of each role and text: a grouped minimum, joined back, so a row that a third of a conversation repeats
is no single task. Conversations are streamed in sorted partitions: while one passes, a byte or two a row is held (the audit has as
many), never its texts. A second stream takes each audit and then the rows in the same order and writes the repaired rows.

Null role and text count as one space. A row whose role has no initial can't be kept. Rows of a null conversation are one conversation. Repeated rows
are duplicates. An empty table gives an empty report and no rows. Only the four named columns are read; others are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

ROLES = "sua"  # the fourth kind is any other initial
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}  # states: at the start, after s, after u, after a
INSERT = (2, 2, 3, 2)
END = (0, 10, 5, 0)  # what remains after the last row
REROLE, DELETE, ADD, CUT = 1, 2, 5, 5
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


class Automaton:
    """Vectors by number, and the two tables that fill while they are used."""

    def __init__(self):
        self.vectors, self.number = [END], {END: 0}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.traces: dict[tuple[int, int, int], tuple[str, int]] = {}

    def arcs(self, after: tuple[int, ...], kind: int) -> list[tuple[str, int, int, int]]:
        """(letter, state, next state, cost with what remains) of the edits that take a row; kind 0 can only be deleted."""
        out = [("D", q, q, DELETE + after[q]) for q in range(4)]
        if kind:
            extra, role = CUT * (kind > 4), "sua?"[(kind - 1) % 4]
            out += [("K", q, to, extra + after[to]) for (q, r), to in KEEP.items() if r == role]
            out += [("R", q, to, REROLE + extra + after[to]) for (q, r), to in KEEP.items() if r != "s"]
        return out

    def before(self, after: tuple[int, ...], kind: int) -> list[int]:
        least = [min(c for _, q, _, c in self.arcs(after, kind) if q == state) for state in range(4)]
        for _ in range(3):
            least = [min(c, ADD + least[INSERT[q]]) for q, c in enumerate(least)]
        return least

    def step(self, vector: int, kind: int) -> tuple[int, int]:
        """The vector before a row of that kind, and what was taken off it."""
        found = self.steps.get((vector, kind))
        if found is None:
            costs = self.before(self.vectors[vector], kind)
            low = min(costs)
            new = tuple(c - low for c in costs)
            at = self.number.setdefault(new, len(self.vectors))
            if at == len(self.vectors):
                self.vectors.append(new)
            found = self.steps[vector, kind] = at, low
        return found

    def trace(self, vector: int, kind: int, states: int) -> tuple[str, int]:
        """The least letters up to and with the one that takes the row (or the end, kind -1), and the states after it."""
        found = self.traces.get((vector, kind, states))
        if found is None:
            after, letters, now = self.vectors[vector], "", {q for q in range(4) if states >> q & 1}
            costs = self.before(after, kind) if kind >= 0 else list(after)
            arcs = self.arcs(after, kind) if kind >= 0 else [("", 0, 0, 0), ("", 3, 3, 0)]
            while True:
                tight = {"I": {INSERT[q] for q in now if costs[q] == ADD + costs[INSERT[q]]}}
                for letter, q, to, c in arcs:
                    if q in now and costs[q] == c:
                        tight.setdefault(letter, set()).add(to)
                letter = min(k for k, v in tight.items() if v)
                letters, now = letters + letter, tight[letter]
                if letter != "I":
                    break
            found = self.traces[vector, kind, states] = letters, sum(1 << q for q in now)
        return found

    def repair(self, kinds: bytes) -> tuple[int, str]:
        """Cost and audit of a conversation whose rows are of these kinds."""
        path, at, cost = bytearray(2 * len(kinds)), 0, 0
        for i in range(len(kinds) - 1, -1, -1):
            path[2 * i], path[2 * i + 1] = at & 255, at >> 8
            at, low = self.step(at, kinds[i])
            cost += low
        out, states = [], 1
        for i, kind in enumerate(kinds):
            letters, states = self.trace(path[2 * i] | path[2 * i + 1] << 8, kind, states)
            out.append(letters)
        return cost + self.vectors[at][0], "".join(out) + self.trace(0, -1, states)[0]


_automaton = Automaton()  # one a Python worker


def _faults(rows: DataFrame) -> DataFrame:
    """rows (_c, _t, _role, _text, _here) with _d, _blank, _cut and _later: whether an earlier turn has the same role and text."""
    turn = F.struct(F.col("_t").isNotNull().alias("a"), F.col("_t").alias("b"))
    told = rows.withColumns({
        "_d": F.sha2(F.concat(F.col("_role"), F.lit("\0"), F.col("_text")), 256), "_blank": ~F.col("_text").rlike(r"[^\x20\x09-\x0D]"), "_cut": ~F.col("_text").rlike(r"[.!?][\x20\x09-\x0D]*\z"),
    })
    keys = told.select("_c", "_t", "_here", F.substring("_role", 1, 1).alias("_i"), "_role", "_d", "_blank", "_cut")
    first = keys.where("_here").groupBy(F.col("_c").alias("_c2"), F.col("_d").alias("_d2")).agg(F.min(turn).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    met = keys.join(first, F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("_d") == F.col("_d2")), "left")
    return met.select("_c", "_t", "_here", "_i", "_role", "_d", "_blank", "_cut", F.coalesce(turn > F.col("_first"), F.lit(False)).alias("_later"))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: counts, cost and audit of each conversation."""
    nobody = object()
    key, last, kinds, got = nobody, None, bytearray(), []
    counts = dict.fromkeys(COUNTS, 0)
    low = high = None
    turns, own_type = 0, None

    def close() -> None:
        cost, audit = _automaton.repair(bytes(kinds))
        got.append((key, high - low + 1 - turns if turns else 0, *(counts[c] for c in COUNTS[1:]), cost, audit))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*got)) if got else [()] * 8
        types = [own_type, *[pa.int64()] * 6, pa.string()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["_c", *COUNTS, "cost", "audit"])
        got.clear()
        return out

    for batch in batches:
        own_type = batch.schema.field("_c").type
        for c, t, here, i, d, blank, cut, later in zip(*(batch.column(n).to_pylist() for n in ("_c", "_t", "_here", "_i", "_d", "_blank", "_cut", "_later"))):
            if c != key:
                if key is not nobody:
                    close()
                    if len(got) >= 1000:
                        yield flush()
                key, last, kinds, turns, low = c, None, bytearray(), 0, None
                counts = dict.fromkeys(COUNTS, 0)
            if not here:
                continue
            if t is not None and (low is None or t != high):
                low, high, turns = t if low is None else low, t, turns + 1
            again = later or (last is not None and last[:2] == (t, d))
            if last is not None and last[2] + i not in ("su", "ua", "au"):
                counts["illegal"] += 1
            if blank or again:
                counts["blank" if blank else "duplicate"] += 1
                kinds.append(0)
            else:
                counts["truncated"] += cut
                at = ROLES.find(i) if i else 3
                kinds.append(1 + (at if at >= 0 else 3) + 4 * cut)
            last = (t, d, i)
    if key is not nobody:
        close()
    if got:
        yield flush()


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation's audit and then its rows, in order: the repaired rows."""
    nobody = object()
    key, audit, at, place, odd, got, size, own_type = nobody, "", 0, 0, 0, [], 0, None

    def role() -> str:
        return "system" if odd and not place else ("user", "assistant")[(place - odd) % 2]

    def insert() -> None:
        nonlocal at, place
        while at < len(audit) and audit[at] == "I":
            got.append((key, place + 1, "I", role(), ""))
            at, place = at + 1, place + 1

    def flush() -> pa.RecordBatch:
        nonlocal size
        types = [own_type, pa.int64(), pa.string(), pa.string(), pa.large_string()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), types)], names=["_c", "place", "edit", "role", "text"])
        got.clear()
        size = 0
        return out

    for batch in batches:
        own_type = batch.schema.field("_c").type
        for c, a, r, t in zip(*(batch.column(n).to_pylist() for n in ("_c", "audit", "_role", "_text"))):
            if a is not None:
                if key is not nobody:
                    insert()
                key, audit, at, place = c, a, 0, 0
                odd = (len(a) - a.count("D")) % 2
                continue
            insert()
            letter = audit[at]
            at += 1
            if letter != "D":
                got.append((key, place + 1, letter, r if letter == "K" else role(), t))
                size, place = size + len(t), place + 1
            if len(got) >= 5000 or size > 1 << 24:
                yield flush()
    if key is not nobody:
        insert()
    if got:
        yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of `role:text` lines of each conversation, of rows in order."""
    nobody = object()
    key, digest, got, own_type = nobody, None, [], None

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], own_type), pa.array([h for _, h in got])], names=["_c", "sha256"])
        got.clear()
        return out

    for batch in batches:
        own_type = batch.schema.field("_c").type
        for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("_c", "role", "text"))):
            if c == key and digest is not None:
                digest.update(b"\n")
            else:
                if digest is not None:
                    got.append((key, digest.hexdigest()))
                    if len(got) >= 1000:
                        yield flush()
                key, digest = c, sha256()
            digest.update(f"{role}:{text}".encode())
    if digest is not None:
        got.append((key, digest.hexdigest()))
    if got:
        yield flush()


class Repaired:
    """What became of some conversations: report (a row each: counts, cost, audit), rows (place, edit, role, text) and digests of those."""

    def __init__(self, df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", here: Column | None = None):
        """`here` is false for rows that only name their conversation."""
        self.conv, scratch = conv, Scratch(df.sparkSession, "repair")
        space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        rows = df.select(F.col(conv).alias("_c"), F.col(turn).cast("long").alias("_t"), space(role).alias("_role"), space(text).alias("_text"), (F.lit(True) if here is None else F.coalesce(here, F.lit(True))).alias("_here"))
        self.kind = rows.schema["_c"].dataType.simpleString()
        order = [F.asc_nulls_first("_t"), "_role", "_d"]
        ordered = _faults(rows).repartition("_c").sortWithinPartitions(F.asc_nulls_first("_c"), *order)
        self._report = scratch.write(ordered.mapInArrow(_report, f"_c {self.kind}, {', '.join(f'{c} long' for c in (*COUNTS, 'cost'))}, audit string"))
        texts = rows.where("_here").select("_c", "_t", "_role", "_text", F.sha2(F.concat(F.col("_role"), F.lit("\0"), F.col("_text")), 256).alias("_d"), F.lit(None).cast("string").alias("audit"))
        none = lambda c, kind: F.lit(None).cast(kind).alias(c)
        audits = self._report.select("_c", none("_t", "long"), none("_role", "string"), none("_text", "string"), none("_d", "string"), "audit")
        met = audits.unionByName(texts).repartition("_c").sortWithinPartitions(F.asc_nulls_first("_c"), F.col("audit").isNull(), *order)
        self._rows = met.select("_c", "audit", "_role", "_text").mapInArrow(_apply, f"_c {self.kind}, place long, edit string, role string, text string")

    @property
    def report(self) -> DataFrame:
        return self._report.withColumnRenamed("_c", self.conv)

    @property
    def rows(self) -> DataFrame:
        return self._rows.withColumnRenamed("_c", self.conv)

    @property
    def digests(self) -> DataFrame:
        """report with repaired_sha256; the rows are hashed as they stream by."""
        own = self._rows.mapInArrow(_digests, f"_c {self.kind}, sha256 string").withColumnRenamed("_c", "_k")
        met = self._report.join(own, F.col("_c").eqNullSafe(F.col("_k")), "left")
        return met.select(F.col("_c").alias(self.conv), *COUNTS, "cost", "audit", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """rows with faults by the CRC-32 of `conv_id:turn` modulo 20, and `here`, false for the dropped ones."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    got = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (kind != 0).alias("here"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return got.drop("copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return Repaired(damaged(table(spark, sf_dir, "conversations")), here=F.col("here")).digests


def _least(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w.c IS NOT NULL))[1]"


def _way(cost: str, to: str, letter: str, when: str = "true") -> str:
    return f"{{'c': CASE WHEN {when} THEN v[{to}].c + {cost} END, 'a': '{letter}' || v[{to}].a}}"


def _taken(q: int) -> str:
    """The cheapest, then least way from state q (from 1) that takes the row first; v is what remains after it."""
    keeps = [("s", 2), ("u", 3)] if q == 1 else [("a", 4)] if q == 3 else [("u", 3)]
    return _least(_way("2", str(q), "D"), *(_way("p", str(to), "K", f"NOT m AND i = '{r}'") for r, to in keeps), *(_way("p + 1", str(to), "R", "NOT m") for r, to in keeps if r != "s"))


def _closed() -> str:
    """b, the ways that take the row first, with insertions before it."""
    add = lambda q, path: _least(f"b[{q}]", *(f"{{'c': b[{x}].c + {5 * k}, 'a': repeat('I', {k}) || b[{x}].a}}" for k, x in enumerate(path, 1)))
    return f"[{add(1, (3, 4))}, {add(2, (3, 4))}, {add(3, (4, 3))}, {add(4, (3, 4))}]"


# An audit for every state by string, without automaton: the least of all ways, from the last row to the first
OP12_SQL = rf"""WITH RECURSIVE x AS (SELECT list(list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crc FROM range(256) r(i)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
d AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(range(0, strlen(s)), lambda i: ord(s[i + 1])::BIGINT), lambda c, v: xor(crc[xor(c, v) % 256 + 1], c >> 8), 4294967295), 4294967295) % 20 AS f FROM k, x),
e AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM d, range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) WHERE f <> 0),
o AS (SELECT *, row_number() OVER w AS n, role[1] AS i, lag(role[1]) OVER w AS prior, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
  NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, count(*) OVER (PARTITION BY conv_id) AS size FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(role || chr(0) || text))),
r AS (SELECT *, blank OR again AS m, CASE WHEN cut THEN 5 ELSE 0 END AS p FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again FROM o)),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate, count_if(cut AND NOT m) AS truncated,
  count_if(prior IS NOT NULL AND prior || i NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
z AS (SELECT conv_id, max(size) AS n, [{{'c': 0, 'a': ''}}, {{'c': 10, 'a': 'II'}}, {{'c': 5, 'a': 'I'}}, {{'c': 0, 'a': ''}}] AS v FROM r GROUP BY conv_id
  UNION ALL SELECT conv_id, n - 1, {_closed()} FROM (SELECT z.conv_id, z.n, [{', '.join(_taken(q) for q in (1, 2, 3, 4))}] AS b FROM z JOIN r ON z.conv_id IS NOT DISTINCT FROM r.conv_id AND z.n = r.n WHERE z.n > 0)),
a AS (SELECT conv_id, v[1].c::BIGINT AS cost, v[1].a AS audit FROM z WHERE n = 0),
l AS (SELECT conv_id, audit, audit[j] AS letter, len(regexp_replace(audit[1:j], 'I', '', 'g')) AS n, len(regexp_replace(audit[1:j], 'D', '', 'g')) AS place, len(regexp_replace(audit, 'D', '', 'g')) % 2 AS odd FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS j FROM a)),
h AS (SELECT l.conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS hash
  FROM l JOIN r ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = greatest(l.n, 1) WHERE letter <> 'D' GROUP BY l.conv_id),
i AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(hash, sha256('')) AS repaired_sha256 FROM i LEFT JOIN c ON i.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON i.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN h ON i.conv_id IS NOT DISTINCT FROM h.conv_id"""
