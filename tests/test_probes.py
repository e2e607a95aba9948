"""Perceptron probes: they learn, and nothing of a fold reaches its own model."""

import numpy as np
from pyspark.sql import functions as F

from cathlight.operators import probes as B


def made(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((240, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)  # no line parts them
    return spark.createDataFrame([(i, int(i) % 30, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, g long, x array<double>, y int")


def test_a_perceptron_learns_what_no_line_can(spark):
    df = made(spark).withColumn("x", F.concat("x", F.array(F.get("x", F.lit(0)) * F.get("x", F.lit(1)))))
    got = B.fold_summary(B.out_of_fold(df, "x", "y", "g", 3, learner=B.perceptron(7)), "y").first()
    assert got.n == 240 and got.folds == 3 and got.accuracy > 0.8 > got.majority and got.f1 > 0.75


def test_a_fold_changes_no_prediction_of_its_own_rows(spark):
    df = made(spark)
    first = {r.id: (r.fold, r.probability) for r in B.out_of_fold(df, "x", "y", "g", 3, learner=B.perceptron(4)).collect()}
    assert first == {r.id: (r.fold, r.probability) for r in B.out_of_fold(df, "x", "y", "g", 3, learner=B.perceptron(4)).collect()}
    some = next(i for i, (fold, _) in first.items() if fold == 0)
    other = df.withColumn("x", F.when((F.col("id") != some) & F.col("id").isin([i for i, (f, _) in first.items() if f == 0]), F.transform("x", lambda v: v * 1000 + 7)).otherwise(F.col("x"))).withColumn("y", F.when(F.col("id") == some, 1 - F.col("y")).otherwise(F.col("y")))
    again = {r.id: r.probability for r in B.out_of_fold(other, "x", "y", "g", 3, learner=B.perceptron(4)).collect()}
    assert again[some] == first[some][1]


def test_the_query_reads_all_labelled_embeddings(spark):
    from cathlight.plans import measures
    from tests.oracle import DATA, duck

    got = measures.perceptron_probe(spark, DATA).first()
    n, yes = duck("SELECT count(*) AS a, sum(toxic) AS b FROM embeddings JOIN labels ON vec_id = doc_id WHERE len(embedding) = 64 AND toxic IS NOT NULL")[1][0]
    assert (got.n, got.folds) == (n, 3) and abs(got.majority - max(yes, n - yes) / n) < 1e-12 and 0.5 < got.accuracy <= 1 and 0 <= got.f1 <= 1
