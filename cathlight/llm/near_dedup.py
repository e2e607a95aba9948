"""Near-duplicate texts by a chosen-path set similarity join (operator 2).

Every text is a set of distinct word shingles. Texts with equal sets are one class from the start.
A class carries COORDS minwise tokens. Each of TREES independent trees begins with two coordinates of
its own, and a class goes on to the child named by the coordinate and the class's token there: two
classes of similarity s share a child with probability s, so at 0.8 a pair shares a first-level node
with probability 1 - 0.2**6, above 0.9999. Nodes with one class end; nodes with at most LEAF classes
are compared exhaustively. A larger node's classes are held against one of them first, and a node
that lies in one component by then is closed, so groups of near copies are not expanded into pairs.
Of the others, nodes with at most MIDDLE classes, or whose components form few pairs, are compared
exhaustively across components (by an index of the node's shingles), and the rest branch: each of them chooses BRANCH coordinates among
those whose tokens tell its components apart best (as a hashed share of its classes shows), since
the tokens of a passage that all of them share would only make the same node again. A pair in
such a node meets a chance of BRANCH more children in each of the nodes that it shares. No node is
capped or dropped; what is still larger after ROUNDS levels is compared exhaustively.

A pair whose minwise tokens agree too rarely for the threshold (by five standard deviations) is passed
over, any other pair is confirmed or refused on the full sets. The tables of a level are written as
the tree grows, so actions run while the result is planned.

Null and empty texts, and texts without a word, have an empty set and are linked with nothing. Texts
with fewer words than a shingle are one shingle. Rows with a null id take no part and come back with
a null component. Different texts of one id are classes of their own, and the id takes the larger
set size and the smaller component. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, components

TREES, COORDS, LEAF, MIDDLE = 3, 64, 6, 4096
BRANCH, DISTINCT, SAMPLE, ROUNDS = 3, 16, 256, 16
BITS = 1 << 27  # of the filter that is broadcast, 16 MB whatever the input; with more than ACTIVE bits set, classes are joined instead
ACTIVE = BITS // 8
SEEDS = K.mix(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
SIGN = "_id long, n_shingles long, _set long, _set2 long, _coords binary"
NODE = ["node", "_id", "component", "n_shingles", "_coords"]
ROW = "node long, _id long, component long, n_shingles long, _coords binary"


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for i, j in K.slices(column):
        words = K.Words(K.Texts(column[i:j]))
        h = words.hashes()
        grams, at = words.grams(h, tuple(range(k)))
        cut = np.searchsorted(at, words.first)
        for d, n in enumerate(words.count.tolist()):
            if n >= k:
                yield np.unique(grams[cut[d] : cut[d + 1]])
            elif n:
                own = np.array([n], np.uint64)
                for x in h[words.first[d] : words.first[d + 1]]:
                    own = K.mix(own + x)
                yield own
            else:
                yield np.zeros(0, np.uint64)


def coordinates(s: np.ndarray) -> np.ndarray:
    """The minwise token of each coordinate, 32 bits of it."""
    out = np.full(COORDS, np.iinfo(np.uint64).max)
    for k in range(0, len(s), 4096):
        x = s[k : k + 4096, None] * SEEDS
        x ^= x >> np.uint64(32)
        out = np.minimum(out, x.min(axis=0))
    return K.mix(out).astype(np.uint32)


def sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            n, one, two, coords = [], [], [], []
            for s in shingle_sets(K.plain(batch, "_text"), k):
                n.append(len(s))
                one.append(int(K.mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                two.append(int(K.mix(s ^ K.MULT[3]).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                coords.append(coordinates(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(coords, pa.binary())], names=["_id", "n_shingles", "_set", "_set2", "_coords"])

    return run


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), COORDS)


def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, _id) of the first level of all trees, from (_id, _coords)."""
    K.release()
    for batch in batches:
        if batch.num_rows:
            token, ids = matrix(batch.column("_coords"))[:, : 2 * TREES].astype(np.uint64), np.asarray(batch.column("_id"))
            node = K.mix((np.arange(1, 2 * TREES + 1, dtype=np.uint64) << np.uint64(32)) + token * K.MULT[5])
            yield pa.RecordBatch.from_arrays([pa.array(node.T.ravel().view(np.int64)), pa.array(np.tile(ids, 2 * TREES))], names=["node", "_id"])


def own_order(node: np.ndarray) -> np.ndarray:
    """Coordinates in an order of each node's own."""
    return np.argsort(K.mix(node[:, None] * K.MULT[4] + np.arange(COORDS, dtype=np.uint64)), axis=1).astype(np.uint8)


def choose(rows: pa.Table) -> pa.Table:
    """(node, picks): BRANCH of the DISTINCT coordinates on which classes of different components meet least, by some of a node's rows."""
    coords, own = matrix(rows.column("_coords")), rows.column("component").to_numpy()
    label = np.unique(own, return_inverse=True)[1].astype(np.uint64)

    def meet(x: np.ndarray) -> int:
        return int((np.unique(x, return_counts=True)[1].astype(np.int64) ** 2).sum())

    together = [meet(coords[:, c]) - meet(coords[:, c].astype(np.uint64) << np.uint64(32) | label) for c in range(COORDS)]
    far = np.argsort(together, kind="stable")[:DISTINCT]
    node = rows.column("node").to_numpy()[:1]
    order = own_order(node.view(np.uint64))[0]
    return pa.table([pa.array(node), pa.array([order[np.isin(order, far)][:BRANCH].tobytes()], pa.binary())], names=["node", "picks"])


def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The children of (node, _id, component, n_shingles, _coords, picks)."""
    K.release()
    kept = ["_id", "component", "n_shingles", "_coords"]
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            part = batch.slice(k, 4096)
            node, coords = np.asarray(part.column("node")).view(np.uint64), matrix(part.column("_coords"))
            picks = own_order(node)[:, :BRANCH].copy()
            told = part.column("picks").to_pylist()
            some = [i for i, x in enumerate(told) if x is not None]
            if some:
                picks[some] = np.frombuffer(b"".join(told[i] for i in some), np.uint8).reshape(len(some), BRANCH)
            for c in picks.T:
                token = coords[np.arange(len(node)), c].astype(np.uint64)
                child = K.mix(node * K.MULT[5] + (c.astype(np.uint64) << np.uint64(32) | token))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *(part.column(x) for x in kept)], names=["node", *kept])


def least_agreement(threshold: float) -> float:
    """Coordinates that a pair of at least this similarity has in common, five standard deviations down."""
    return COORDS * threshold - 5 * (COORDS * threshold * (1 - threshold)) ** 0.5


def likely(percent: int):
    """Pairs whose sizes and minwise tokens allow the threshold."""
    least = least_agreement(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            if batch.num_rows:
                same = (matrix(batch.column("ca")) == matrix(batch.column("cb"))).sum(axis=1) >= least
                yield batch.select(["a", "b"]).filter(pa.array(same))

    return run


def by_node(work):
    """work(table) over whole nodes, from rows sorted by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                node = np.asarray(part.column("node"))
                cut = int(np.flatnonzero(node == node[-1])[0])
                if cut or (held and held[-1].column("node")[-1].as_py() != node[0]):
                    yield work(pa.Table.from_batches([*held, part.slice(0, cut)]))
                    held = []
                held.append(part.slice(cut))
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def likely_pairs(rows: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (node, component, n_shingles, _coords) of the same node and different components that may be links, one distance in the table at a time."""
    least = least_agreement(percent / 100)
    node, n, own = (rows.column(c).to_numpy() for c in ("node", "n_shingles", "component"))
    coords = matrix(rows.column("_coords"))
    for d in range(1, len(node)):
        x = np.flatnonzero(node[:-d] == node[d:])
        if not len(x):
            break
        x = x[own[x] != own[x + d]]
        x = x[100 * np.minimum(n[x], n[x + d]) >= percent * np.maximum(n[x], n[x + d])]
        x = x[(coords[x] == coords[x + d]).sum(axis=1) >= least]
        yield x, x + d


def pairs_within(percent: int):
    def work(rows: pa.Table) -> pa.RecordBatch:
        ids, none = rows.column("_id").to_numpy(), np.zeros(0, np.int64)
        x, y = (np.concatenate([none, *z]) for z in zip((none, none), *likely_pairs(rows, percent)))
        got = np.unique(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], names=["a", "b"])

    return by_node(work)


def partnered(percent: int):
    """The rows with a likely partner in their node."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        some = np.zeros(rows.num_rows, bool)
        for x, y in likely_pairs(rows, percent):
            some[x] = some[y] = True
        own = pa.array(np.flatnonzero(some))
        return pa.RecordBatch.from_arrays([rows.column(c).combine_chunks().take(own) for c in NODE], names=NODE)

    return by_node(work)


def links_within(percent: int):
    """Links that join the components of a node, on the full sets s: each row outside a node's largest component against all its rows, by an index of the node's shingles."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        node, ids, own = (rows.column(c).to_numpy() for c in ("node", "_id", "component"))
        size, out = rows.column("n_shingles").to_numpy(), []
        cut = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)] if len(node) else []
        for a, b in zip(cut[:-1], cut[1:]):
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("s").slice(a, b - a).to_pylist()]
            row = np.repeat(np.arange(b - a), [len(x) for x in sets])
            order = np.argsort(token := np.concatenate(sets), kind="stable")
            place, holder = np.searchsorted(token[order], token), row[order]
            end = np.searchsorted(token[order], token, "right")
            first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            part, n = own[a:b].copy(), size[a:b]
            name, times = np.unique(part, return_counts=True)
            for i in np.flatnonzero(part != name[times.argmax()]).tolist():
                lo, count = place[first[i] : first[i + 1]], (end - place)[first[i] : first[i + 1]]
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
                both = np.bincount(holder[at], minlength=b - a)
                near = np.flatnonzero((100 * both >= percent * (n[i] + n - both)) & (part != part[i]))
                for j in near[np.unique(part[near], return_index=True)[1]].tolist():
                    out.append((min(ids[a + i], ids[a + j]), max(ids[a + i], ids[a + j])))
                if len(near):
                    part[np.isin(part, part[near])] = part[i]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return by_node(work)


def linked(one: bytes, two: bytes, percent: int) -> bool:
    x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with n_shingles, component_id and kept; links have 100 * intersection >= percent * union.

    Columns of docs that clash with these names are replaced.
    """
    added = ["n_shingles", "component_id", "kept"]
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).where("_id is not null")
    signed = scratch.write(base.mapInArrow(sign(shingle), SIGN))
    reps = scratch.write(
        signed.where("n_shingles > 0").groupBy("_set", "_set2", "n_shingles").agg(F.min(F.struct("_id", "_coords")).alias("r")).select(F.col("r._id").alias("_id"), F.col("r._coords").alias("_coords"), "n_shingles", "_set", "_set2")
    )
    coords = reps.select("_id", "_coords", "n_shingles")
    spent: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        spent.append(scratch.write(df))
        return spent[-1]

    def hopeful(pairs: DataFrame) -> DataFrame:
        ca = coords.select(F.col("_id").alias("a"), F.col("_coords").alias("ca"), F.col("n_shingles").alias("na"))
        cb = coords.select(F.col("_id").alias("b"), F.col("_coords").alias("cb"), F.col("n_shingles").alias("nb"))
        sized = pairs.distinct().join(ca, "a").join(cb, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        return sized.select("a", "b", "ca", "cb").mapInArrow(likely(percent), "a long, b long")

    def stars(nodes: DataFrame) -> DataFrame:
        """Each large node's classes against the first of them."""
        pivot = nodes.groupBy("node").agg(F.min("_id").alias("p"))
        return hopeful(nodes.select("node", "_id").join(pivot, "node").where("_id <> p").select(F.col("p").alias("a"), F.col("_id").alias("b")))

    def whole(nodes: DataFrame) -> DataFrame:
        """Rows of a node side by side."""
        return nodes.repartition("node").sortWithinPartitions("node", "_id")

    def inside(nodes: DataFrame) -> DataFrame:
        """Links across the components of nodes; only rows with a likely partner meet their full sets."""
        some = whole(nodes.select(*NODE)).mapInArrow(partnered(percent), ROW)
        rows = some.join(full.select("_id", "s"), "_id").select(*NODE, "s")
        return whole(rows).mapInArrow(links_within(percent), "a long, b long")

    def mixed(nodes: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows of the nodes that hold more than one component, with n, major and few.

        major is the node's largest component; few says that pairs across its components are no more than its rows times LEAF.
        """
        told = nodes.join(labels, nodes["_id"] == labels["id"], "left").withColumn("component", F.coalesce("component", "_id")).drop("id")
        parts = told.groupBy("node", "component").agg(F.count("*").alias("c"))
        sizes = parts.groupBy("node").agg(F.count("*").alias("parts"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.max(F.struct("c", "component"))["component"].alias("major"))
        several = sizes.where("parts > 1").select("node", "n", "major", (F.col("n") * F.col("n") - F.col("sq") <= 2 * LEAF * F.col("n")).alias("few"))
        return keep(told.join(several, "node"))

    def across(nodes: DataFrame) -> DataFrame:
        """All pairs of different components: every class outside a node's largest component against the others."""
        x = nodes.where("component <> major").select("node", F.col("_id").alias("a"), F.col("component").alias("x"))
        y = nodes.select("node", F.col("_id").alias("b"), F.col("component").alias("y"))
        return hopeful(x.join(y, "node").where("x <> y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))

    def grow(nodes: DataFrame) -> DataFrame:
        """The children of large nodes that hold more than one component, with their size."""
        share = F.ceil(F.col("n") / SAMPLE)
        picks = nodes.where(F.pmod(F.xxhash64("_id"), share) == 0).select(*NODE).groupBy("node").applyInArrow(choose, "node long, picks binary")
        below = keep(nodes.select(*NODE).join(picks, "node", "left").mapInArrow(branch, ROW))
        size = below.groupBy("node").agg(F.count("*").alias("size"), F.min("component").alias("x"), F.max("component").alias("y"))
        return keep(below.join(size.where("x < y").select("node", "size"), "node"))

    # the first level says which classes may have a partner; their full sets are kept from here on
    planted = reps.select("_id", "_coords").mapInArrow(plant, "node long, _id long")
    level = keep(planted.join(planted.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "node"))
    large = level.where(F.col("size") > LEAF).select("node", "_id")
    small = level.where(F.col("size") <= LEAF).withColumn("component", F.col("_id")).join(coords, "_id").select(*NODE)
    pairs = keep(whole(small).mapInArrow(pairs_within(percent), "a long, b long").unionByName(stars(large)).distinct())
    active = pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).union(large.select("_id"))
    spot = F.pmod(F.xxhash64("_id"), F.lit(BITS)) + 1
    bits, marks = np.zeros(BITS // 8, np.uint8), 0
    found = active.groupBy(F.bitmap_bucket_number(spot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("m")).withColumn("n", F.bitmap_count("m"))
    for r in found.collect():  # at most BITS / 8 bytes
        bits[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(bytes(r.m), np.uint8)
        marks += r.n
    some = base.withColumn("_spot", spot - 1)
    if marks > ACTIVE:
        some, shared = some.join(active.distinct(), "_id", "left_semi"), None
    else:
        shared = spark.sparkContext.broadcast(bits)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            if shared is not None:
                at = np.asarray(batch.column("_spot"))
                batch = batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            sets = list(shingle_sets(K.plain(batch, "_text"), shingle))
            sums = [int(K.mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sums, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["_id", "_set", "s"])

    found = some.mapInArrow(members, "_id long, _set long, s binary")
    full = keep(found.join(reps.select("_id", "_set"), ["_id", "_set"], "left_semi").dropDuplicates(["_id", "_set"]))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                good = [linked(x, y, percent) for x, y in zip(part.column("sa").to_pylist(), part.column("sb").to_pylist())]
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def confirm(pairs: DataFrame) -> DataFrame:
        """The pairs that are links, on full sets."""
        one = full.select(F.col("_id").alias("a"), F.col("s").alias("sa"))
        two = full.select(F.col("_id").alias("b"), F.col("s").alias("sb"))
        return pairs.join(one, "a").join(two, "b").mapInArrow(check, "a long, b long")

    labels = components(scratch, confirm(pairs))
    for depth in range(1, ROUNDS + 1):
        split = mixed(large, labels)
        if split.isEmpty():
            break
        told = split.where((F.col("n") <= MIDDLE) | ~F.col("few"))
        if depth == 1:  # from here on the rows carry their coordinates
            told = told.join(coords, "_id")
        small = told.where((F.col("n") <= MIDDLE) | (F.lit(depth == ROUNDS) & ~F.col("few")))
        wide = split.where(F.col("n") > MIDDLE)
        rest = told.where((F.col("n") > MIDDLE) & ~F.col("few"))
        over = depth == ROUNDS or rest.isEmpty()
        new = inside(small)
        if not wide.where("few").isEmpty():
            new = new.unionByName(confirm(across(wide.where("few")).distinct()))
        if not over:
            below = grow(rest)
            large = below.where(F.col("size") > MIDDLE).select("node", "_id", "n_shingles", "_coords")
            new = new.unionByName(inside(below.where(F.col("size") <= MIDDLE)))
            over = large.isEmpty()
            if not over:
                new = new.unionByName(confirm(stars(large).distinct()))
        new = keep(new)
        if not new.isEmpty():
            before = labels
            labels = components(scratch, labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(new))
            spent.append(before)
        if over:
            break
    scratch.drop(*spent)
    # a class's id is its smallest one, so its label is the smallest id of the component
    named = reps.join(labels, reps["_id"] == labels["id"], "left").select("_set", "_set2", "n_shingles", F.coalesce("component", "_id").alias("component"))
    rows = signed.join(named, ["_set", "_set2", "n_shingles"], "left").select("_id", "n_shingles", F.coalesce("component", "_id").alias("component"))
    told = rows.groupBy("_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component").alias("component_id"))
    out = docs.drop(*added).withColumn("_id", F.col(id_col).cast("long")).join(told, "_id", "left").drop("_id")
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")
