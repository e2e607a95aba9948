"""Cohort rules over studies and sequences: eligibility, violations, completeness, ordering, splits and status rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import ladder
from ..functions.values import index0, number


def keep_yes_no(df: DataFrame, column: str) -> DataFrame:
    """Rows whose answer is yes or no after trimming and lower-casing."""
    tidy = F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))
    return df.withColumn(column, tidy).where(F.col(column).isin("yes", "no"))


def yes_no_report(df: DataFrame, column: str) -> DataFrame:
    """before and after of keep_yes_no, in one pass."""
    tidy = F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))
    return df.agg(F.count("*").alias("before"), F.count_if(tidy.isin("yes", "no")).alias("after"))


def outlier(c: Column, low: float, high: float) -> Column:
    """Below low or above high; text counts by its number, and what has none is no outlier."""
    return F.coalesce(~number(c).between(low, high), F.lit(False))


def signals(strong: dict[str, Column], weak: dict[str, Column]) -> Column:
    """struct<hit, triggers>: at least one strong signal or two weak ones, and the names of all that fired, in order."""
    fired = lambda c: F.coalesce(c, F.lit(False))
    count = lambda rules: sum((fired(c).cast("int") for c in rules.values()), F.lit(0))
    names = F.concat_ws(" | ", *(F.when(fired(c), F.lit(n)) for n, c in {**strong, **weak}.items()))
    return F.struct(((count(strong) >= 1) | (count(weak) >= 2)).alias("hit"), names.alias("triggers"))


def inside_box(box: dict[str, tuple[float | None, float | None]]) -> Column:
    """Whether every named statistic lies within its bounds; None is open."""
    out = F.lit(True)
    for name, (low, high) in box.items():
        out &= (F.col(name) >= low if low is not None else F.lit(True)) & (F.col(name) <= high if high is not None else F.lit(True))
    return F.coalesce(out, F.lit(False))


def frame_reason(frames: Column, least: int) -> Column:
    """kept, removed for fewer frames than least, or missing."""
    return F.when(frames.isNull(), "missing").when(frames < least, "removed").otherwise("kept")


def frame_window(best: Column, first: Column, last: Column, mode: str) -> Column:
    """struct<kept, best, first, last> of frame numbers that are text and count from 1, as indices from 0, -1 for none.

    A last frame before the first makes both none. Mode `best` needs the best frame, `fl` the first and the last, any other nothing.
    """
    b, f, n = (index0(c) for c in (best, first, last))
    wrong = (f >= 0) & (n >= 0) & (n < f)
    f, n = F.when(wrong, -1).otherwise(f), F.when(wrong, -1).otherwise(n)
    kept = {"best": b >= 0, "fl": (f >= 0) & (n >= 0)}.get(mode, F.lit(True))
    return F.struct(kept.alias("kept"), b.alias("best"), f.alias("first"), n.alias("last"))


def presence(targets: DataFrame, rows: DataFrame, key: str, visual: Column) -> DataFrame:
    """state of each target key: missing, found with any visual row, or found without one."""
    seen = rows.groupBy(key).agg(F.bool_or(visual).alias("_visual"))
    state = F.when(F.col("_visual").isNull(), "missing").when(F.col("_visual"), "visual").otherwise("no_visual")
    return targets.select(key).distinct().join(seen, key, "left").withColumn("state", state).drop("_visual")


def complete_keys(df: DataFrame, key: str, kind: str, expected: list[str]) -> DataFrame:
    """complete and missing (the expected kinds that a key lacks, in order)."""
    have = df.groupBy(key).agg(F.collect_set(F.when(F.col(kind).isin(expected), F.col(kind))).alias("_have"))
    lacks = F.array_except(F.array(*map(F.lit, expected)), F.col("_have"))
    return have.select(key, (F.size(lacks) == 0).alias("complete"), F.array_join(lacks, ",").alias("missing"))


def lookup(df: DataFrame, key: str, table: DataFrame, value: str, default: str = "NOT FOUND") -> DataFrame:
    """df with the value that table has for key (its smallest, if several), else the default."""
    one = table.groupBy(key).agg(F.min(value).alias(value))
    return df.join(one, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def any_listed(df: DataFrame, key: str, items: str, allowed: DataFrame, item: str) -> DataFrame:
    """The rows of df whose list has an element among the allowed ones."""
    hits = df.select(key, F.explode(items).alias(item)).join(allowed.select(item), item, "left_semi").select(key).distinct()
    return df.join(hits, key, "left_semi")


def with_augmented(df: DataFrame, key: str, kind: str, text: str, original: str, placeholder: str = "-") -> DataFrame:
    """Each original row beside every other row of its key, or a placeholder."""
    own = df.where(F.col(kind) == original).select(key, F.col(text).alias("original"))
    others = df.where(F.col(kind) != original).select(key, F.col(kind).alias("variant"), F.col(text).alias("augmented"))
    return own.join(others, key, "left").withColumns({"variant": F.coalesce("variant", F.lit(placeholder)), "augmented": F.coalesce("augmented", F.lit(placeholder))})


def update_where(df: DataFrame, match: Column, changes: dict[str, Column]) -> DataFrame:
    """UPDATE ... SET changes WHERE match; a null match changes nothing."""
    return df.withColumns({c: F.when(match, x).otherwise(F.col(c)) for c, x in changes.items()})


def delete_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def with_key_column(df: DataFrame, column: str, constant: str) -> DataFrame:
    """A table of an older schema with the key column it lacks; rows that have one keep it, so it can run again."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(constant)) if column in df.columns else F.lit(constant))


def to_do(df: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """Rows that no completed status row names: new ones, ones in progress when a run ended, and errors."""
    return df.join(status.where("status = 'completed'").select(key), key, "left_anti")


def work_queue(items: DataFrame, labels: DataFrame, key: str, labeler: str, person: str) -> DataFrame:
    """The items that a person has not labelled, with done and total of all items."""
    mine = labels.where(F.col(labeler) == person).select(key).distinct().withColumn("_done", F.lit(1))
    marked = items.join(mine, key, "left")
    counts = marked.agg(F.count("_done").alias("done"), F.count("*").alias("total"))
    return marked.where("_done is null").drop("_done").join(F.broadcast(counts))  # one row


def stable_hash(*columns: Column) -> Column:
    """A number of 32 bits that any engine with MD5 can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("long")


def group_folds(df: DataFrame, group: str, folds: int, seed: str = "0") -> DataFrame:
    """fold of each row by its group's hash: no group is on two sides, and no row moves when others come."""
    return df.withColumn("fold", stable_hash(F.lit(seed), F.col(group).cast("string")) % folds)


def keep_share(df: DataFrame, group: str, key: str, share: float, seed: str = "0") -> DataFrame:
    """max(1, round(n * share)) rows of each group, those of the least hash."""
    own = Window.partitionBy(group)
    rank = F.row_number().over(own.orderBy(stable_hash(F.lit(seed), F.col(key).cast("string")), key))
    return df.withColumns({"_rn": rank, "_n": F.count("*").over(own)}).where(F.col("_rn") <= F.greatest(F.lit(1), F.bround(F.col("_n") * share))).drop("_rn", "_n")


def subset_indices(n: Column, share: float) -> Column:
    """ceil(n * share) indices spread over 0 to n - 1 (floored), padded with the lowest that are missing."""
    k = F.greatest(F.lit(1), F.ceil(n * share)).cast("int")
    spread = F.when(k == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(i * (n - 1) / (k - 1).cast("double")).cast("int")))
    own = F.array_distinct(spread)
    others = F.array_except(F.sequence(F.lit(0), n.cast("int") - 1), own)
    return F.array_sort(F.concat(own, F.slice(others, F.lit(1), F.greatest(k - F.size(own), F.lit(0)))))


def fixed_keys(found: Column, keys: Column, default: str, most: int) -> Column:
    """The text that a map has for each of the keys, in their order, cut to `most` characters, else a default; other entries go."""
    return F.transform(keys, lambda k: F.substring(F.coalesce(F.element_at(found, k), F.lit(default)), 1, most))


def interleaved(df: DataFrame, category: str, hit: str, order: str, most: int) -> DataFrame:
    """At most `most` rows of each category, hits and misses by turns."""
    turn = F.row_number().over(Window.partitionBy(category, hit).orderBy(order))
    place = F.row_number().over(Window.partitionBy(category).orderBy("_turn", F.desc(hit)))
    return df.withColumn("_turn", turn).where(F.col("_turn") <= most).withColumn("place", place).where(F.col("place") <= most).drop("_turn")


def checkpoint_order(name: Column) -> Column:
    """Sort key of checkpoint names: numbered epochs by number, then last, then others by name."""
    epoch = F.regexp_extract(name, r"epoch[_-]?(\d+)", 1).try_cast("int")
    return F.struct(F.when(epoch.isNotNull(), 0).when(F.lower(name).contains("last"), 1).otherwise(2).alias("kind"), F.coalesce(epoch, F.lit(0)).alias("epoch"), name.alias("name"))


def chronological(*parts: Column) -> Column:
    """Sort key of nullable parts in which what is missing comes after what is there."""
    return F.struct(*(x for i, p in enumerate(parts) for x in (p.isNull().alias(f"n{i}"), p.alias(f"v{i}"))))


def coded(c: Column, codes: dict[str, str]) -> Column:
    """A category by its code; what has none keeps its name."""
    return ladder(c, *((c == k, F.lit(v)) for k, v in codes.items()))


def top_against_median(values: Column, k: int) -> Column:
    """struct<top, median, ratio>: the mean of the k largest values of an array against its median."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    top, middle = mean(F.slice(F.reverse(ordered), 1, k)), (F.get(ordered, ((n - 1) / 2).cast("int")) + F.get(ordered, (n / 2).cast("int"))) / 2
    return F.when(n > 0, F.struct(top.alias("top"), middle.alias("median"), (top / (middle + 1e-6)).alias("ratio")))


def means_as_read(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Mean of some columns by key, added up in the order of file names and of rows in them; nulls are left out. df is read from Parquet files, and the rows of a key fit in a task.

    Sums of doubles differ in their last bits with the order of adding, and those bits decide between means that are equal on paper. So the result doesn't depend on how tables are cut.
    """
    places = ("_metadata.file_path", "_metadata.row_index")
    rows = df.select(key, F.struct(*(F.col(p).alias(f"_{i}") for i, p in enumerate(places)), *(F.col(c).cast("double").alias(c) for c in columns)).alias("_row"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    values = lambda c: F.filter(F.transform("_rows", lambda r: r[c]), lambda x: x.isNotNull())
    mean = lambda c: F.when(F.size(values(c)) > 0, F.aggregate(values(c), F.lit(0.0), lambda s, x: s + x) / F.size(values(c)))
    return listed.select(key, *(mean(c).alias(c) for c in columns))


def best_of(columns: list[str], baseline: str) -> Column:
    """struct<name, delta>: the column with the highest value (the first of equals) and its lead over the baseline."""
    top = F.greatest(*columns)
    return F.struct(ladder(F.lit(None).cast("string"), *((F.col(c) == top, F.lit(c)) for c in columns)).alias("name"), (top - F.col(baseline)).alias("delta"))
