"""Learned decision lists over text statistics, in Spark expressions (operator 5).

Statistics of whole texts come from string and array functions. Rules are learned from labelled rows
by sequential covering: a rule grows by the threshold condition of greatest information gain on two
thirds of the rows, is pruned on the other third, and what it covers leaves before the next one.
The list becomes one conditional expression: the first rule that holds rejects a text, and a text
that no rule rejects is kept. At most SAMPLE labelled rows are learned from, those with the least
hash of their id; only their statistics come to the driver.

Null texts have no words, lines or symbols. Labels that are null are not learned from, of several
labels of one id the least counts, and without labels nothing is rejected but by the base rules.
Repeated rows are judged alike. Columns that clash with the added names are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

SAMPLE = 20_000
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["word_length", "symbol_share", "line_share", "repeat_share", "upper_share", "mark_share", "n_words"]


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with BASE (long, over whole texts) and FEATURES (double)."""
    docs = docs.drop(*BASE, *FEATURES)
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    first = docs.withColumns({"_w": words, "_lines": lines})
    # equal windows lie side by side once sorted by hash; the positions of those that do are then merged in order
    windows = F.when(F.size("_w") < 4, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i"))))
    )
    near = first.withColumn("_g", windows)
    twice = F.sort_array(
        F.transform(F.filter("_g", lambda x, k: (x["h"] == F.get("_g", k - 1)["h"]) | (x["h"] == F.get("_g", k + 1)["h"])), lambda x: x["i"])
    )
    met = near.withColumn("_p", twice)
    covered = F.aggregate(F.transform("_p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    out = met.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": without(BLANKS).cast("long"),
            "n_symbols": (F.length(text) - without(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered.cast("long"),
            "_n_lines": F.size("_lines"),
            "_upper": F.length(text) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "_marks": F.length(text) - without("!?{}[]=;/\\@_"),
        }
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    out = out.withColumns(
        {"word_length": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "n_words"), "line_share": share("n_dup_lines", "_n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "upper_share": share("_upper", "word_chars"), "mark_share": share("_marks", "n_words")}
    )
    return out.drop("_w", "_lines", "_g", "_p", "_n_lines", "_upper", "_marks")


Condition = tuple[str, str, float]


def holds(x: dict, rule: list[Condition]) -> bool:
    return all(x[f] >= t if op == ">=" else x[f] <= t for f, op, t in rule)


def learn(rows: list[dict], features: list[str] = FEATURES, cuts: int = 48, most: int = 12) -> list[list[Condition]]:
    """Ordered rules for rows with bad = 1, each a conjunction of (feature, >= or <=, threshold)."""
    grow_rows, prune_rows = [x for i, x in enumerate(rows) if i % 3], [x for i, x in enumerate(rows) if not i % 3]
    rules: list[list[Condition]] = []
    while len(rules) < most and any(x["bad"] for x in grow_rows):
        rule: list[Condition] = []
        inside = grow_rows
        while len(rule) < 4:
            p0 = sum(x["bad"] for x in inside)
            if p0 in (0, len(inside)):
                break
            start, best = math.log2(p0 / len(inside)), (0.0, None)
            for f in features:
                order = sorted((x[f], x["bad"]) for x in inside)
                n = len(order)
                below = [0]
                for _, bad in order:
                    below.append(below[-1] + bad)
                for k in sorted({n * c // cuts for c in range(1, cuts)} | {i for i in range(1, min(n, 24))} | {n - i for i in range(1, min(n, 24))}):
                    if order[k - 1][0] == order[k][0]:
                        continue
                    middle = (order[k - 1][0] + order[k][0]) / 2
                    for op, p, size in (("<=", below[k], k), (">=", p0 - below[k], n - k)):
                        gain = p * (math.log2(p / size) - start) if p else 0
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, op, middle))
            if best[1] is None:
                break
            rule.append(best[1])
            inside = [x for x in inside if holds(x, [best[1]])]
        if not rule:
            break

        def worth(r: list[Condition]) -> float:
            own = [x["bad"] for x in prune_rows if holds(x, r)]
            return (2 * sum(own) - len(own)) / len(own) if own else -1.0

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)
        if worth(rule) < 0.5:  # three in four, at least, of what it rejects
            break
        rules.append(rule)
        grow_rows, prune_rows = [x for x in grow_rows if not holds(x, rule)], [x for x in prune_rows if not holds(x, rule)]
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list: false where a rule holds, else true."""
    out = F.lit(True)
    for rule in reversed(rules):
        met = F.lit(True)
        for f, op, t in rule:
            met = met & (F.col(f) >= t if op == ">=" else F.col(f) <= t)
        out = F.when(met, F.lit(False)).otherwise(out)
    return out


def learned_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[list[Condition]]:
    """Rules for the label 0, from at most SAMPLE labelled rows of docs."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_q")).where("_id is not null and _q is not null")
    sample = own.groupBy("_id").agg(F.min("_q").alias("_q")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    stats = statistics(chosen, "_text").select("_id", (1 - F.col("_q")).alias("bad"), *FEATURES)
    got = [r.asDict() for r in stats.orderBy(F.xxhash64("_id"), "_id", *FEATURES).limit(SAMPLE).collect()]
    return learn(got)


def judge_quality(docs: DataFrame, rules: list[list[Condition]], text_col: str = "text") -> DataFrame:
    """docs with BASE, base_failed and kept."""
    out = statistics(docs.drop("base_failed", "kept"), text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumns({"base_failed": failed, "_kept": verdict(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("_kept")).drop("_kept", *[f for f in FEATURES if f not in BASE])


def keep_good(docs: DataFrame, rules: list[list[Condition]], text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their own columns.

    The row number holds the filter above the statistics: pushed below them, it would repeat their
    nested expressions many times over.
    """
    judged = judge_quality(docs.withColumnRenamed("kept", "_own_kept") if "kept" in docs.columns else docs, rules, text_col)
    out = judged.withColumn("_row", F.monotonically_increasing_id()).where("kept and _row >= 0")
    return out.select(*[F.col("_own_kept").alias("kept") if c == "kept" else F.col(c) for c in docs.columns])


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learned_rules(docs, table(spark, sf_dir, "labels"))
    return judge_quality(docs, rules).select("doc_id", *BASE, "base_failed", "kept")
