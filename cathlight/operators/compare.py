"""Model against model: all pairs of baseline and tuned predictions in one pass, their ranking, and averages over folds and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import ratio, upper_tail


def compare_pairs(predictions: DataFrame, keys: list[str], model: str, truth: str, answer: str, tuned: Column) -> DataFrame:
    """One row for each baseline and tuned model: n, right in both, one and neither, accuracies, delta, McNemar's p, winner and status.

    Rows meet on all keys; a pair of models without a common row is there with n = 0 and status failed. Repeated answers
    of a model to one key count once (the smallest). The rows of a key are gathered as two lists of at most as many entries as models.
    """
    own = predictions.groupBy(*keys, model).agg(F.min(answer).alias("_a"), F.min(truth).alias("_t"), F.min(tuned).alias("_tuned"))
    cell = F.struct(F.col(model).alias("m"), (F.col("_a") == F.col("_t")).alias("ok"))
    sides = own.groupBy(*keys).agg(F.collect_list(F.when(~F.col("_tuned"), cell)).alias("x"), F.collect_list(F.when(F.col("_tuned"), cell)).alias("y"))
    met = sides.select(F.explode("x").alias("x"), "y").select("x", F.explode("y").alias("y"))
    x, y = F.col("x.ok"), F.col("y.ok")
    counts = met.groupBy(F.col("x.m").alias("baseline"), F.col("y.m").alias("tuned")).agg(
        F.count("*").alias("n"), F.count_if(x & y).alias("both_right"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("both_wrong")
    )
    models = own.groupBy(model).agg(F.max("_tuned").alias("_tuned"))
    grid = models.where("not _tuned").select(F.col(model).alias("baseline")).join(F.broadcast(models.where("_tuned").select(F.col(model).alias("tuned"))))  # models, a short list
    full = grid.join(counts, ["baseline", "tuned"], "left").fillna(0, ["n", "both_right", "b", "c", "both_wrong"])
    return scored_pairs(full)


def scored_pairs(counts: DataFrame) -> DataFrame:
    """counts with accuracies, delta, chi_square (continuity-corrected), p, winner, status and priority."""
    b, c, n = F.col("b"), F.col("c"), F.col("n")
    base, own = ratio(F.col("both_right") + b, n), ratio(F.col("both_right") + c, n)
    chi = F.when(b + c > 0, F.pow(F.abs(b - c) - 1, F.lit(2.0)) / (b + c)).otherwise(0.0)
    p = F.when(n == 0, F.lit(None).cast("double")).when(b + c == 0, 1.0).otherwise(upper_tail(F.col("chi_square")))
    scored = counts.withColumns({"baseline_accuracy": base, "tuned_accuracy": own, "delta": own - base, "chi_square": chi, "status": F.when(n == 0, "failed").otherwise("ok")}).withColumn("p", p)
    winner = F.when(F.col("p") >= 0.05, "none").when(F.col("delta") > 0, "tuned").when(F.col("delta") < 0, "baseline").otherwise("none")
    return with_priority(scored.withColumn("winner", F.when(n > 0, winner)))


def with_priority(df: DataFrame) -> DataFrame:
    """priority 0 for a significant win of the tuned model, 1 for another significant result, 2 for the rest."""
    significant = F.coalesce(F.col("p") < 0.05, F.lit(False))
    return df.withColumn("priority", F.when(significant & (F.col("delta") > 0), 0).when(significant, 1).otherwise(2))


def ranked(df: DataFrame) -> DataFrame:
    """By priority, then rising p, then falling delta; what has no number comes last."""
    return df.orderBy("priority", F.asc_nulls_last("p"), F.desc_nulls_last("delta"), "baseline", "tuned")


def micro_macro(df: DataFrame, label: str, correct: Column) -> DataFrame:
    """n and accuracy of each label, and two rows more: MICRO over all rows, MACRO as the plain mean of labels."""
    per = df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"), F.sum(correct.cast("long")).alias("ok"))
    total = per.agg(F.sum("n").alias("n"), (F.sum("ok") / F.sum("n")).alias("micro"), F.avg(F.col("ok") / F.col("n")).alias("macro"))
    rows = total.select(F.inline(F.array(F.struct(F.lit("MICRO").alias("label"), F.col("n"), F.col("micro").alias("accuracy")), F.struct(F.lit("MACRO").alias("label"), F.col("n"), F.col("macro").alias("accuracy")))))
    return per.select("label", "n", (F.col("ok") / F.col("n")).alias("accuracy")).unionByName(rows)


def over_folds(df: DataFrame, by: list[str], fold: str, correct: Column) -> DataFrame:
    """folds, mean accuracy and its population deviation (null for a single fold)."""
    per = df.groupBy(*by, fold).agg(F.avg(correct.cast("double")).alias("a"))
    return per.groupBy(*by).agg(F.count("*").alias("folds"), F.avg("a").alias("mean"), F.when(F.count("*") >= 2, F.stddev_pop("a")).alias("sd"))


def with_and_without(df: DataFrame, by: list[str], flag: Column, value: str, polarity: Column) -> DataFrame:
    """Means with and without a component, their delta, the delta signed so that more is better, and its direction."""
    m = df.groupBy(*by).agg(F.avg(F.when(flag, F.col(value))).alias("with_mean"), F.avg(F.when(~flag, F.col(value))).alias("without_mean"), F.max(polarity).alias("_p"))
    delta = F.col("with_mean") - F.col("without_mean")
    out = m.withColumn("delta", delta).withColumn("gain", F.col("delta") * F.col("_p"))
    return out.withColumn("direction", F.when(F.col("gain") > 0, "better").when(F.col("gain") < 0, "worse").when(F.col("gain") == 0, "same")).drop("_p")


def pooled_confusion(positives: DataFrame, negatives: DataFrame, key: str, predicted: str) -> DataFrame:
    """outcome (TP, FN, FP, TN) of each row of a pool of positives and one of negatives."""
    rows = positives.select(key, predicted, F.lit(True).alias("truth")).unionByName(negatives.select(key, predicted, F.lit(False).alias("truth")))
    hit = F.coalesce(F.col(predicted), F.lit(False))
    return rows.withColumn("outcome", F.when(F.col("truth"), F.when(hit, "TP").otherwise("FN")).otherwise(F.when(hit, "FP").otherwise("TN")))


def confusion_tip(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    return F.format_string("TP=%d TN=%d FP=%d FN=%d", tp, tn, fp, fn)


def parse_confusion_tip(c: Column) -> Column:
    """struct<tp, tn, fp, fn> of such a text; null where a count is missing."""
    return F.struct(*(F.regexp_extract(c, rf"\b{k}\s*=\s*(\d+)", 1).try_cast("long").alias(k.lower()) for k in ("TP", "TN", "FP", "FN")))


def parse_scores(c: Column, names: list[str]) -> Column:
    """map<name, ratio> of `name: number` lines of console output; numbers above 1 are percent."""
    value = lambda n: F.regexp_extract(c, rf"(?im)^\s*{n}\s*[:=]\s*([0-9.]+)\s*%?", 1).try_cast("double")
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.when(value(n) > 1, value(n) / 100).otherwise(value(n)) for n in names)))


def constant_controls(df: DataFrame, by: str, truth: str) -> DataFrame:
    """tp, fp and fn for class yes of always-yes and always-no answers, and their F1, for each question."""
    counts = df.groupBy(by).agg(F.count_if(F.col(truth) == 1).alias("yes"), F.count_if(F.col(truth) == 0).alias("no"))
    rows = F.array(F.struct(F.lit("all_yes").alias("control"), ratio(2 * F.col("yes"), 2 * F.col("yes") + F.col("no")).alias("f1_yes"), F.lit(0.0).alias("f1_no")), F.struct(F.lit("all_no").alias("control"), F.lit(0.0).alias("f1_yes"), ratio(2 * F.col("no"), 2 * F.col("no") + F.col("yes")).alias("f1_no")))
    return counts.select(by, F.inline(rows)).withColumn("f1_macro", (F.col("f1_yes") + F.col("f1_no")) / 2)
