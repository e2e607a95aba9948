"""Probes on frozen features: logistic regression by grouped folds, and what is reported from its out-of-fold predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from .cohort import group_folds
from .quantiles import wide_quantiles

NAMES = {"featuresCol": "_x", "labelCol": "_y", "probabilityCol": "_p", "predictionCol": "_c", "rawPredictionCol": "_r"}


def feature_mode(mode: str, sequence: Column, question: Column, yes: Column, no: Column) -> Column:
    """Features of a sequence and a question, arrays of one size. concat: both; interact: and their product; hyp: the sequence, its products with both hypotheses, its similarity to each and the difference."""
    times = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)
    if mode == "concat":
        return F.concat(sequence, question)
    if mode == "interact":
        return F.concat(sequence, question, times(sequence, question))
    if mode == "hyp":
        a, b = dot(sequence, yes), dot(sequence, no)
        return F.concat(sequence, times(sequence, yes), times(sequence, no), F.array(a, b, a - b))
    raise ValueError(f"no mode {mode}")


def margin_feature(df: DataFrame, family: str, sequence: Column, yes: Column, no: Column, name: str) -> DataFrame:
    """df with one feature: the margin of the hypotheses less the median of its family, in which no label takes part."""
    margins = df.withColumn("_margin", dot(sequence, yes) - dot(sequence, no))
    middle = wide_quantiles(margins, "_margin", {"_middle": 0.5}, [family]).withColumnRenamed(family, "_family")
    met = margins.join(middle, F.col(family).eqNullSafe(F.col("_family")))
    return met.withColumn(name, F.array(F.col("_margin") - F.col("_middle"))).drop("_margin", "_middle", "_family")


def perceptron(components: int, hidden: tuple[int, ...] = (32, 16), seed: int = 42) -> Callable[[int], Estimator]:
    """For a number of features: scaling, principal components and a perceptron of two classes, to be fitted together."""

    def learner(size: int) -> Estimator:
        k = min(components, size)
        net = MultilayerPerceptronClassifier(**(NAMES | {"featuresCol": "_k"}), layers=[k, *hidden, 2], seed=seed, maxIter=100)
        return Pipeline(stages=[StandardScaler(inputCol="_x", outputCol="_s", withMean=True), PCA(k=k, inputCol="_s", outputCol="_k"), net])

    return learner


def out_of_fold(df: DataFrame, features: str, label: str, group: str, folds: int, reg: float = 1e-3, seed: str = "0", learner: Callable[[int], Estimator] | None = None) -> DataFrame:
    """df with fold, probability and predicted (0 or 1) of a model that saw no row of the fold: a logistic regression, or what `learner` makes for a number of features.

    Folds go by the hash of the group, so no group is on both sides. Features are arrays of one size; rows whose features, label or
    group is null take no part. A fold whose other rows have one label only, or none, gets that label's probability (null for none).
    """
    usable = df.where(F.col(features).isNotNull() & F.col(label).isNotNull() & F.col(group).isNotNull())
    rows = group_folds(usable, group, folds, seed).withColumns({"fold": F.col("fold").cast("int"), "_x": array_to_vector(F.col(features).cast("array<double>")), "_y": F.col(label).cast("double")})
    counts = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("_y").alias("positive")).collect()  # one row a fold
    sizes, seen = ({r["fold"]: r[c] for r in counts} for c in ("n", "positive"))
    width = rows.select(F.max(F.size(features))).first()[0] if learner else None
    make = (lambda: learner(width)) if learner else (lambda: LogisticRegression(**NAMES, regParam=reg))
    parts = []
    for fold in sorted(seen):
        n, positive = sum(sizes.values()) - sizes[fold], sum(seen.values()) - seen[fold]
        own = rows.where(F.col("fold") == fold)
        if 0 < positive < n:
            model = make().fit(rows.where(F.col("fold") != fold))
            parts.append(model.transform(own).withColumn("probability", vector_to_array("_p")[1]).drop("_p", "_c", "_r", "_s", "_k"))
        else:
            parts.append(own.withColumn("probability", F.lit(positive / n if n else None).cast("double")))
    if not parts:
        parts = [rows.withColumn("probability", F.lit(None).cast("double"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("predicted", (F.col("probability") >= 0.5).cast("int")).drop("_x", "_y")


def probe_report(predicted: DataFrame, label: str, by: list[str]) -> DataFrame:
    """n, correct, accuracy and balanced accuracy (null where a class is missing) of out-of-fold predictions by question, question group or all."""
    hit = lambda v: F.count_if((F.col(label) == v) & (F.col("predicted") == v)) / F.nullif(F.count_if(F.col(label) == v), F.lit(0))
    correct = F.count_if(F.col(label) == F.col("predicted"))
    return predicted.where("predicted is not null").groupBy(*by).agg(F.count("*").alias("n"), correct.alias("correct"), (correct / F.count("*")).alias("accuracy"), ((hit(1) + hit(0)) / 2).alias("balanced"))


def fold_summary(predicted: DataFrame, label: str) -> DataFrame:
    """n, folds, the mean and deviation (population) of the folds' accuracies, their mean F1 of class 1, and the share of the larger class."""
    y, p = F.col(label), F.col("predicted")
    per = predicted.where("predicted is not null").groupBy("fold").agg(F.count("*").alias("n"), F.sum(y).alias("yes"), F.avg((y == p).cast("double")).alias("accuracy"), F.coalesce(F.try_divide(2.0 * F.count_if((y == 1) & (p == 1)), (F.count_if(y == 1) + F.count_if(p == 1)).cast("double")), F.lit(0.0)).alias("f1"))
    share = F.sum("yes") / F.sum("n")
    return per.agg(F.sum("n").alias("n"), F.count("*").alias("folds"), F.avg("accuracy").alias("accuracy"), F.stddev_pop("accuracy").alias("accuracy_sd"), F.avg("f1").alias("f1"), F.greatest(share, 1 - share).alias("majority"))
