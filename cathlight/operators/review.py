"""Literature-review records: screening gates, metric names, checklists, aligned answers, annotators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import has_any, ladder
from ..functions.text import strip
from .evaluate import ratio, wilson

# Metric names by pattern, in order, with 1 where more is better and -1 where less is
METRICS = [
    (r"\b(dice|dsc|sorensen[-_]?dice|dice[-_]?coefficient)\b", "Dice", 1), (r"\b(f1[-_ ]?score?|f[-_]?measure|f1)\b", "F1 Score", 1),
    (r"\b(iou|jaccard|intersection.over.union)\b", "IoU", 1), (r"\b(acc(uracy)?)\b", "Accuracy", 1),
    (r"\b(sens(itivity)?|recall|tpr|true.positive.rate)\b", "Sensitivity", 1), (r"\b(spec(ificity)?|tnr)\b", "Specificity", 1),
    (r"\b(prec(ision)?|ppv)\b", "Precision", 1), (r"\b(au[rc]|auroc|auc[-_ ]?roc|area.under)\b", "AUC", 1), (r"\b(psnr|peak.signal)\b", "PSNR", 1),
    (r"\b(ssim|structural.similarity)\b", "SSIM", 1), (r"\b(mse|mean.squared.error)\b", "MSE", -1), (r"\b(rmse|root.mean.squared)\b", "RMSE", -1),
    (r"\b(mae|mean.absolute.error)\b", "MAE", -1), (r"\b(hd95|hausdorff.95|95.hausdorff)\b", "HD95", -1), (r"\b(hd|hausdorff)\b", "HD", -1),
    (r"\b(fps|frames.per.second)\b", "FPS", 1), (r"\b(inference.time|latency)\b", "Latency", -1), (r"\b(map|mean.average.precision)\b", "mAP", 1),
    (r"\b(clot.detection|lesion.detection)\b", "Detection", 1),
]
RATIOS = ["Dice", "IoU", "Accuracy", "Sensitivity", "Specificity", "Precision", "AUC", "SSIM", "Detection", "F1 Score"]
FAMILIES = [
    ("Overlap-based (F1/Dice)", ["f1", "dice"]), ("Overlap-based (IoU)", ["iou", "jaccard"]), ("Ranking-based (AUC)", ["auc", "roc"]),
    ("Accuracy", ["accuracy"]), ("Detection-based (Precision/Recall)", ["precision", "recall"]),
]


def metric(c: Column) -> Column:
    """struct<name, polarity> of a metric's free-text name."""
    s, one = F.lower(strip(c)), lambda n, p: F.struct(n.alias("name"), F.lit(p).alias("polarity"))
    other = F.when(F.coalesce(s, F.lit("")) == "", one(F.lit("Unknown"), 1)).otherwise(one(F.initcap(s), 1))
    return ladder(other, *[(s.rlike(p), one(F.lit(n), polarity)) for p, n, polarity in METRICS])


def metric_family(c: Column) -> Column:
    return ladder(F.lit("Other"), *[(has_any(F.lower(c), needles), F.lit(f)) for f, needles in FAMILIES])


def as_ratio(value: Column, name: Column) -> Column:
    """Percent values of ratio metrics as ratios."""
    return F.when(name.isin(RATIOS) & (value > 1), value / 100).otherwise(value)


def screen(df: DataFrame, inclusion: str = "inclusion", exclusion: str = "exclusion") -> DataFrame:
    """decision and failed_at from the two gates' answers (pass, fail, uncertain; null where a call failed).

    The exclusion gate counts only behind a passed inclusion gate; uncertain records count as failed at inclusion and are flagged.
    """
    i, e = F.lower(inclusion), F.lower(exclusion)
    decision = F.when(i.isNull(), "ERROR").when(i == "uncertain", "UNCERTAIN").when(i != "pass", "EXCLUDE").when(e.isNull(), "ERROR").when(e == "uncertain", "UNCERTAIN").when(e == "pass", "INCLUDE").otherwise("EXCLUDE")
    at = F.when(i.isNull() | (i != "pass"), "inclusion").when(e == "uncertain", "inclusion").when(e.isNull() | (e != "pass"), "exclusion")
    return df.withColumns({"decision": decision, "failed_at": at}).withColumn("flagged", F.col("decision").isin("UNCERTAIN", "ERROR"))


def settle_uncertain(df: DataFrame, decision: str = "decision", met: str = "met", failed: str = "failed") -> DataFrame:
    """Uncertain records fail criterion I1 alone and no longer meet it."""
    own = F.upper(decision) == "UNCERTAIN"
    return df.withColumns({met: F.when(own, F.array_remove(F.coalesce(met, F.array().cast("array<string>")), "I1")).otherwise(F.col(met)), failed: F.when(own, F.array(F.lit("I1"))).otherwise(F.col(failed))})


def adherence(df: DataFrame, items: str, by: list[str] | None = None) -> DataFrame:
    """yes, no, na, proportion and bounds of each checklist item in a map<item, answer>; NA is outside the proportion."""
    cells = df.select(*(by or []), F.explode(items).alias("item", "answer"))
    a = F.upper(strip(F.col("answer")))
    got = cells.groupBy(*(by or []), "item").agg(F.count_if(a == "YES").alias("yes"), F.count_if(a == "NO").alias("no"), F.count_if(~a.isin("YES", "NO")).alias("na"))
    n = F.col("yes") + F.col("no")
    low, high = wilson(F.col("yes"), n)
    return got.withColumns({"proportion": ratio(F.col("yes"), n), "low": low, "high": high})


def boolean_profile(df: DataFrame, paths: list[str]) -> DataFrame:
    """true, false and missing counts of boolean paths; missing is whatever has neither."""
    sums = df.agg(F.count("*").alias("n"), *[F.struct(F.lit(p).alias("path"), F.count_if(F.col(p)).alias("yes"), F.count_if(~F.col(p)).alias("no")).alias(f"_{k}") for k, p in enumerate(paths)])
    return sums.select("n", F.inline(F.array(*[f"_{k}" for k in range(len(paths))]))).select("path", "yes", "no", (F.col("n") - F.col("yes") - F.col("no")).alias("missing"))


def align_to_bank(answers: DataFrame, bank: DataFrame, key: str, question: str = "question", answer: str = "answer", position: str = "position") -> DataFrame:
    """One row for each key and bank question in bank order; n/a where there is no answer. A key meets the bank as one array."""
    keys = answers.select(key).distinct()
    whole = bank.agg(F.collect_list(F.struct(question, position)).alias("_bank"))
    wanted = keys.join(F.broadcast(whole)).select(key, F.inline("_bank"))  # one row, the bank
    own = answers.groupBy(key, question).agg(F.min(answer).alias(answer))
    return wanted.join(own, [key, question], "left").withColumn(answer, F.coalesce(answer, F.lit("n/a")))


def agreed(master: DataFrame, first: DataFrame, second: DataFrame, adjudicated: DataFrame, key: str = "sample_id") -> DataFrame:
    """Labels on which two annotators agree, else the adjudicated one, else pending."""
    a, b, c = (df.select(key, F.nullif(strip(F.col("decision")), F.lit("")).alias(n)) for df, n in ((first, "a"), (second, "b"), (adjudicated, "c")))
    both = master.join(a, key).join(b, key).join(c, key, "left")
    return both.withColumn("label", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.coalesce("c", F.lit("PENDING"))))
