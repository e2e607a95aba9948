"""Order over a whole table without a window over one task: row numbers, running sums, first-seen groups, node ids.

Rows are dealt by ranges of their sort key and sorted inside each range. Ranges are counted (and summed), and each begins where
the ones before it end: a table of one row a partition, which is broadcast. The dealt rows are cut from their lineage first, since
ranges are drawn from a sample and a second run could draw others.

Rows with equal keys are told apart by the place they were read from, so a key that a third of all rows share is still dealt over
many ranges; which of them comes first is then not told, so give a unique last key where it matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut

INSIDE = 33  # bits of monotonically_increasing_id() that number the rows of a partition


def _dealt(df: DataFrame, order: tuple[Column | str, ...]) -> DataFrame:
    """df with _at, which grows in the given order, and _part, the range of a row."""
    tie = "_at"
    read = df.withColumn(tie, F.monotonically_increasing_id())
    ranged = read.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie).drop(tie)
    return cut(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", INSIDE))


def _starts(counts: DataFrame, columns: list[str]) -> DataFrame:
    """What the ranges before each one have of some columns; a row a partition."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as partitions
    return counts.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in columns))


def numbered(df: DataFrame, *order: Column | str, name: str = "place", start: int = 1) -> DataFrame:
    """df with each row's place in the given order, from `start` on."""
    dealt = _dealt(df, order)
    starts = _starts(dealt.groupBy("_part").agg(F.count("*").alias("_n")), ["_n"])
    place = F.col("_before__n") + F.col("_at").bitwiseAND((1 << INSIDE) - 1) + start
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, place).select(*df.columns, name)


def running(df: DataFrame, *order: Column | str, sums: dict[str, str], name: str = "place") -> DataFrame:
    """df with place (from 1), a running sum of each column of `sums` under its key, and `<key>_total`; a null adds nothing."""
    dealt = _dealt(df, order)
    upto = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(F.coalesce(c, F.lit(0))).alias(k) for k, c in sums.items()))
    totals = parts.agg(*(F.sum(k).alias(f"{k}_total") for k in sums))
    starts = _starts(parts, ["_n", *sums]).join(F.broadcast(totals))  # one row each
    inner = dealt.withColumns({f"_own_{k}": F.sum(F.coalesce(c, F.lit(0))).over(upto) for k, c in sums.items()})
    met = inner.join(F.broadcast(starts), "_part")
    place = F.col("_before__n") + F.col("_at").bitwiseAND((1 << INSIDE) - 1) + 1
    return met.select(*df.columns, place.alias(name), *((F.col(f"_before_{k}") + F.col(f"_own_{k}")).alias(k) for k in sums), *(f"{k}_total" for k in sums))


def cumulative_share(df: DataFrame, key: str) -> DataFrame:
    """Each value of a column with its count c, its place by count (then value) and the share of all rows up to it."""
    counts = df.groupBy(key).agg(F.count("*").alias("c"))
    return running(counts, F.desc("c"), key, sums={"_upto": "c"}).select(key, "c", "place", (F.col("_upto") / F.col("_upto_total")).alias("share"))


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each key with group_place, its place by the least `order` among its rows (ties by key), first_order and n: groups as a reader meets them.

    A null key is a group; a group without any order comes last.
    """
    groups = df.groupBy(key).agg(F.min(order).alias("first_order"), F.count("*").alias("n"))
    return numbered(groups, F.asc_nulls_last("first_order"), key, name="group_place")


def grouped_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of df with the place of their group by first appearance and their own place inside it.

    One global numbering by (group, order); a row's own place is what lies between it and its group's first, so no group is one task.
    """
    groups = first_seen(df, key, order)
    starts = running(groups.select(F.col(key).alias("_k"), "group_place", "n"), "group_place", sums={"_upto": "n"}).select("_k", "group_place", (F.col("_upto") - F.col("n")).alias("_start"))
    met = df.join(starts, F.col(key).eqNullSafe(F.col("_k"))).select(*df.columns, "group_place", "_start")
    return numbered(met, "group_place", F.asc_nulls_last(order), name="_place").withColumn("row_place", F.col("_place") - F.col("_start")).drop("_start", "_place")


# First id of each kind of node, and least and most size by degree
ID_STEP = 10_000
LEFT_SIZE, WHOLE_SIZE, CUT_SIZE = (12, 14, 36), (10, 12, 34), 14


def _size(degree: Column, base: int, least: int, most: int) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), base + 3 * degree))


def graphs(df: DataFrame, order: str, left: str, rights: dict[str, str], cut_kinds: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph, kind, name, full_text, id, degree, size) and distinct edges (graph, source_id, target_id): one bipartite graph a right column.

    Names are trimmed; blank ones, and 'N/A' to the right, make no node. A kind in `cut_kinds` is named by its first so many characters and
    keeps the whole text of its least `order`. Ids are ranks by name, from 0 for the left nodes, ID_STEP on for the first right kind, and so
    on (the next power of ten where a kind has more nodes). A left node has one id, is in the graphs in which it has an edge, and has its
    degree there.
    """
    tidy = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    kinds = list(rights)
    text = {k: F.nullif(tidy(rights[k]), F.lit("N/A")) for k in kinds}
    pairs = F.array(*(F.struct(F.lit(k).alias("graph"), (F.substring(text[k], 1, cut_kinds[k]) if k in cut_kinds else text[k]).alias("target"), text[k].alias("full_text")) for k in kinds))
    rows = df.select(tidy(left).alias("source"), F.col(order).alias("_o"), pairs.alias("p")).where("source is not null")
    edges = cut(rows.select("source", "_o", F.inline("p")).where("target is not null").groupBy("graph", "source", "target").agg(F.min(F.struct("_o", "full_text")).alias("_first")))
    lefts = rows.select(F.lit(-1).alias("_kind"), F.col("source").alias("name")).distinct()
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("graph")).cast("int") - 1
    targets = edges.select(rank.alias("_kind"), F.col("target").alias("name")).distinct()
    placed = cut(numbered(lefts.unionByName(targets), "_kind", "name", name="_place", start=0))
    span = placed.groupBy("_kind").agg(F.min("_place").alias("_least"), F.count("*").alias("_n"))  # a row a kind
    step = span.agg(F.pow(F.lit(10), F.greatest(F.lit(4), F.ceil(F.log10(F.max("_n"))))).cast("long").alias("_step"))
    ids = placed.join(F.broadcast(span), "_kind").join(F.broadcast(step)).select("_kind", "name", (F.col("_place") - F.col("_least") + (F.col("_kind") + 1) * F.col("_step")).alias("id"))
    ids = cut(ids)
    of = lambda name, out: ids.where("_kind = -1" if name == "source" else "_kind >= 0").select(*(["_kind"] if name == "target" else []), F.col("name").alias(name), F.col("id").alias(out))
    wired = edges.withColumn("_kind", rank).join(of("source", "source_id"), "source").join(of("target", "target_id"), ["_kind", "target"])
    a = wired.groupBy("graph", F.lit("left").alias("kind"), F.col("source").alias("name"), F.col("source_id").alias("id")).agg(F.count("*").alias("degree"), F.first("source").alias("full_text"))
    b = wired.groupBy("graph", F.lit("right").alias("kind"), F.col("target").alias("name"), F.col("target_id").alias("id")).agg(F.count("*").alias("degree"), F.min("_first")["full_text"].alias("full_text"))
    size = F.when(F.col("kind") == "left", _size(F.col("degree"), *LEFT_SIZE)).when(F.col("graph").isin(list(cut_kinds)), CUT_SIZE).otherwise(_size(F.col("degree"), *WHOLE_SIZE))
    return a.unionByName(b).withColumn("size", size), wired.select("graph", "source_id", "target_id")
