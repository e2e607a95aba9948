"""Records matched, merged and paired: bibliographic merges, closest templates, contained keys, adjudication, pooled folds and funnels."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.text import strip
from ..sources.scratch import cut


def merge_records(df: DataFrame, order: str, first: str, second: str, source: str) -> DataFrame:
    """(order, merged) of the records that stay: one with neither the first key (a DOI) nor the second (a title) of an earlier one that stays.

    Keys count in lower case without white space around them, the second by its letters, digits and blanks; blank ones match nothing.
    `merged` lists the sources of a record and of all that fell to it: those of its first key, else those of its second. A record that
    falls hides no other, so the answer depends on the order; each round settles all records that come first in both groups, and their
    followers. Order values are distinct. A key of many records is a minimum with partial aggregation and a join with one row a key.
    """
    key = lambda c: F.lower(strip(F.coalesce(F.col(c), F.lit(""))))
    plain = F.nullif(F.regexp_replace(key(second), "[^a-z0-9 ]", ""), F.lit(""))
    rows = cut(df.select(F.col(order).alias("_o"), F.nullif(key(first), F.lit("")).alias("_a"), plain.alias("_b"), F.col(source).alias("_s")))
    open_rows, kept = rows.select("_o", "_a", "_b"), None
    while not open_rows.isEmpty():
        least = {k: open_rows.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("_o").alias(f"_first{k}")) for k in ("_a", "_b")}
        marked = open_rows.join(least["_a"], "_a", "left").join(least["_b"], "_b", "left")
        leads = (F.col("_a").isNull() | (F.col("_o") == F.col("_first_a"))) & (F.col("_b").isNull() | (F.col("_o") == F.col("_first_b")))
        marked = cut(marked.withColumn("_lead", leads))
        now = marked.where("_lead").select("_o", "_a", "_b")
        kept = now if kept is None else kept.unionByName(now)
        open_rows = cut(marked.where("not _lead").join(now.select("_a"), "_a", "left_anti").join(now.select("_b"), "_b", "left_anti").select("_o", "_a", "_b"))
    if kept is None:
        kept = rows.select("_o", "_a", "_b")
    head = lambda k: kept.where(F.col(k).isNotNull()).select(k, F.col("_o").alias(f"_head{k}"))
    before = lambda k: F.when(F.col(f"_head{k}") <= F.col("_o"), F.col(f"_head{k}"))
    met = rows.join(head("_a"), "_a", "left").join(head("_b"), "_b", "left").withColumn("_to", F.coalesce(before("_a"), before("_b"), "_o"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_s"))), lambda x: x["_s"]), ", ")
    return met.groupBy(F.col("_to").alias(order)).agg(listed.alias("merged"))


MATCH = StructType([StructField("match", StringType()), StructField("score", DoubleType())])


def closest(templates: list[str]):
    """A function of a text column to struct<match, score>: the template of greatest matching-blocks ratio, the first of equals; null text has none.

    Templates are a short, given list that travels with the function.
    """

    @F.pandas_udf(MATCH)
    def best(texts: pd.Series) -> pd.DataFrame:
        def one(text):
            if text is None or not templates:
                return None, None
            scores = [difflib.SequenceMatcher(None, text, t).ratio() for t in templates]
            at = max(range(len(scores)), key=scores.__getitem__)
            return templates[at], scores[at]

        return pd.DataFrame([one(t) for t in texts], columns=["match", "score"])

    return best


def match_template(df: DataFrame, text: str, templates: list[str], threshold: float) -> DataFrame:
    """df with match, score and strategy (exact, fuzzy or none); each different text is compared once."""
    best = closest(templates)
    seen = df.select(text).where(F.col(text).isNotNull()).distinct()
    apart = seen.where(~F.col(text).isin(templates)).select(text, best(F.col(text)).alias("_m"))
    exact = seen.where(F.col(text).isin(templates)).select(text, F.struct(F.col(text).alias("match"), F.lit(1.0).alias("score")).alias("_m"))
    met = df.join(exact.unionByName(apart), text, "left")
    strategy = F.when(F.col(text).isin(templates), "exact").when(F.col("_m.score") >= threshold, "fuzzy").otherwise("none")
    return met.select(*(df[c] for c in df.columns), F.when(strategy != "none", F.col("_m.match")).alias("match"), F.col("_m.score").alias("score"), strategy.alias("strategy"))


def first_path(df: DataFrame, key: str, paths: DataFrame, path: str, pattern: str = r"[0-9]+(?:\.[0-9]+)+") -> DataFrame:
    """df with the first path (by name) that holds its key as a whole token of the pattern: an equi-join on the tokens of paths, not on pairs."""
    tokens = paths.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(path), F.lit(pattern), F.lit(0)))).alias(key), path)
    return df.join(tokens.groupBy(key).agg(F.min(path).alias(path)), key, "left")


def with_scores(df: DataFrame, key: str, scores: DataFrame, model: str, value: str, models: list[str]) -> DataFrame:
    """df with one column a model: its score for the row's key to three places, null for none."""
    wide = scores.groupBy(key).pivot(model, models).agg(F.round(F.max(value), 3))
    return df.join(wide, key, "left")


def study_pairs(reports: DataFrame, key: str, uids: str, text: str, files: DataFrame, uid: str, path: str, least: int = 1) -> DataFrame:
    """(key, n, paths, prompt) of the studies with at least `least` of their listed files; paths in order, and the report under a line that counts them."""
    listed = reports.select(key, F.explode(F.array_distinct(uids)).alias(uid)).join(files.select(uid, path), uid)
    sets = listed.groupBy(key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(path)).alias("paths")).where(F.col("n") >= least)
    prompt = F.concat(F.lit("Sequences: "), F.col("n").cast("string"), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))
    return sets.join(reports.select(key, text), key).select(key, "n", "paths", prompt.alias("prompt"))


def readout_f1(predicted: DataFrame, truth: DataFrame, keys: list[str], question: str, order: str) -> DataFrame:
    """(question, n, f1): macro F1 of the first prediction (pred, 0 or 1) of each key against its truth, over the classes that occur."""
    one = predicted.where("pred is not null").groupBy(*keys).agg(F.min_by("pred", order).alias("pred"))
    met = one.join(truth.select(*keys, "truth"), keys)
    cell = lambda t, p: F.count_if((F.col("truth") == t) & (F.col("pred") == p))
    counts = met.groupBy(question).agg(F.count("*").alias("n"), cell(1, 1).alias("tp"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"))
    wrong = F.col("fp") + F.col("fn")
    each = F.filter(F.array(F.struct(F.col("tp").alias("hit")), F.struct(F.col("tn").alias("hit"))), lambda c: c["hit"] + wrong > 0)
    f1 = F.aggregate(each, F.lit(0.0), lambda s, c: s + 2 * c["hit"] / (2 * c["hit"] + wrong)) / F.size(each)
    return counts.select(question, "n", F.round(f1, 3).alias("f1"))


def adjudicated(samples: DataFrame, key: str, a: DataFrame, b: DataFrame, judged: DataFrame, label: str = "label") -> DataFrame:
    """Every sample with a, b, final (what both said, else the adjudicated label, else blank) and disputed (both there and apart)."""
    own = lambda df, name: df.groupBy(key).agg(F.min(label).alias(name))
    met = samples.select(key).distinct().join(own(a, "a"), key, "left").join(own(b, "b"), key, "left").join(own(judged, "_j"), key, "left")
    final = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.coalesce("_j", F.lit("")))
    return met.select(key, "a", "b", final.alias("final"), F.coalesce(F.col("a") != F.col("b"), F.lit(False)).alias("disputed"))


def pooled_folds(df: DataFrame, by: list[str], folds: int) -> DataFrame:
    """Fold rows (fold, correct, evaluated, skipped, n_train, n_test) pooled: sums, means over all folds, and the accuracies of folds with an evaluated row."""
    rates = F.sort_array(F.collect_list(F.when(F.col("evaluated") > 0, F.struct("fold", (F.col("correct") / F.col("evaluated")).alias("rate")))))
    return df.groupBy(*by).agg(
        *(F.sum(c).alias(c) for c in ("correct", "evaluated", "skipped")),
        *(F.bround(F.sum(c) / folds).cast("long").alias(c) for c in ("n_train", "n_test")),
        F.transform(rates, lambda r: r["rate"]).alias("fold_rates"),
    )


def funnel_rows(counts: DataFrame, layout: list[tuple[str, str]]) -> DataFrame:
    """(place, stage, metric, sequences, frames): the rows of a layout in order, null where counts lack one, then other metrics of its stages by name."""
    spark = counts.sparkSession
    plan = spark.createDataFrame([(i, s, m) for i, (s, m) in enumerate(layout)], "place int, stage string, metric string")
    fixed = plan.join(counts, ["stage", "metric"], "left")
    rest = counts.join(F.broadcast(plan.select("stage").distinct()), "stage", "left_semi").join(F.broadcast(plan), ["stage", "metric"], "left_anti")
    last = F.row_number().over(Window.orderBy("stage", "metric")) + (len(layout) - 1)  # the few metrics of a report
    return fixed.select("place", "stage", "metric", "sequences", "frames").unionByName(rest.select(last.alias("place"), "stage", "metric", "sequences", "frames"))


def nested_ranks(near: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """(query_id, group, similarity, rank, items): the n best groups of each query, and their items by best similarity with ranks from 1."""
    best = near.groupBy("query_id", group, item).agg(F.max("similarity").alias("s"))
    members = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("d"), F.col(item).alias("i")))), lambda x, at: F.struct((at + 1).alias("rank"), x["i"].alias("id"), (-x["d"]).alias("similarity")))
    groups = best.groupBy("query_id", group).agg(F.max("s").alias("similarity"), members.alias("items"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), group))
    return groups.withColumn("rank", rank).where(F.col("rank") <= n)


def informative(df: DataFrame, group: str, key: str, measures: dict[str, float], trivial: Column, percent: float) -> DataFrame:
    """df with score and label: of a group's rows that aren't trivial, max(1, round(n * percent / 100)) of the greatest sum of weighted, min-max scaled measures are informative."""
    rows = df.withColumn("_t", F.coalesce(trivial, F.lit(True)))
    bounds = rows.where("not _t").groupBy(group).agg(F.count("*").alias("_n"), *(f(m).alias(f"_{f.__name__}_{m}") for m in measures for f in (F.min, F.max)))
    span = lambda m: F.col(f"_max_{m}") - F.col(f"_min_{m}")
    score = sum((w * F.when(span(m) == 0, 0.0).otherwise((F.col(m) - F.col(f"_min_{m}")) / span(m)) for m, w in measures.items()), F.lit(0.0))
    met = rows.join(bounds, group, "left").withColumn("score", F.when(~F.col("_t"), F.round(score, 9)))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last("score"), key))
    chosen = F.col("score").isNotNull() & (place <= F.greatest(F.lit(1), F.bround(F.col("_n") * percent / 100)))
    return met.withColumn("label", F.when(chosen, "informative").otherwise("uninformative")).select(*df.columns, "score", "label")


def hashed_words(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, bucket, weight): words in lower case without punctuation around them, counted in `size` buckets of a hash that any engine repeats, at unit length."""
    bare = F.lower(F.regexp_replace("word", r"""^[.,!?;:()\[\]{}"']+|[.,!?;:()\[\]{}"']+$""", ""))
    words = df.select(key, F.explode(F.split(text, r"\s+")).alias("word")).select(key, bare.alias("word")).where("word <> ''")
    bucket = (F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % size).alias("bucket")
    counts = words.select(key, bucket).groupBy(key, "bucket").agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))  # at most `size` rows a key
    return counts.select(key, "bucket", (F.col("n") / norm).alias("weight"))


def attention_pool(frames: DataFrame, group: str, vector: str, query: Column, heat: float = 0.1) -> DataFrame:
    """(group, at, value): the frames of a group, weighted by softmax(dot(frame, query) / heat), summed and at unit length, one row a dimension."""
    dot = F.aggregate(F.zip_with(vector, query, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = frames.select(group, F.col(vector).alias("_v"), (dot / heat).alias("_s"))
    most = scored.groupBy(group).agg(F.max("_s").alias("_m"))
    cells = scored.join(most, group).select(group, F.exp(F.col("_s") - F.col("_m")).alias("_w"), F.posexplode("_v").alias("at", "_x"))
    sums = cells.groupBy(group, "at").agg((F.sum(F.col("_w") * F.col("_x"))).alias("_y"))
    return sums.select(group, "at", (F.col("_y") / F.sqrt(F.sum(F.col("_y") * F.col("_y")).over(Window.partitionBy(group)))).alias("value"))
