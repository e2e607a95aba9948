from pyspark.sql import functions as F

from cathlight.operators import curate as C
from cathlight.operators import evaluate as E


def test_weighted_scores(spark):
    row = E.with_scores(spark.createDataFrame([(3, 4, 2, 3)], "tp long, tn long, fp long, fn long")).first()
    assert [round(row[c], 4) for c in ("accuracy", "precision_weighted", "recall_weighted", "f1_weighted")] == [0.5833, 0.5857, 0.5833, 0.5804]


def pairs(spark, b, c):
    rows = [(1, 1, 0)] * b + [(1, 0, 1)] * c + [(1, 1, 1)]
    return E.paired(spark.createDataFrame(rows, "t int, x int, y int"), "t", "x", "y").first()


def test_mcnemar(spark):
    assert abs(pairs(spark, 8, 2).p - 0.109375) < 1e-12
    big = pairs(spark, 30, 10)
    assert abs(big.chi_square - 9.025) < 1e-12 and abs(big.p - 0.0026631) < 1e-6
    assert pairs(spark, 0, 0).p == 1.0


def test_wilson_and_cochran(spark):
    df = spark.createDataFrame([(5, 10), (0, 10), (45, 50), (0, 0)], "k long, n long")
    low, high = E.wilson(F.col("k"), F.col("n"))
    got = [(round(r.l, 6), round(r.h, 6)) for r in df.select(low.alias("l"), high.alias("h")).collect()]
    assert got == [(0.23659, 0.76341), (0.0, 0.27754), (0.786395, 0.956525), (0.0, 0.0)]
    assert spark.range(1).select(E.cochran(F.lit(1000)).alias("n")).first().n == 278


def test_kappa(spark):
    rows = [("a", "a")] * 4 + [("a", "b")] * 1 + [("b", "b")] * 5
    got = E.kappa(spark.createDataFrame(rows, "x string, y string"), "x", "y").first()
    assert abs(got.po - 0.9) < 1e-12 and abs(got.pe - (0.5 * 0.4 + 0.5 * 0.6)) < 1e-12


def test_concentration(spark):
    rows = [(v,) for v, n in (("a", 5), ("b", 3), ("c", 1), ("d", 1)) for _ in range(n)]
    got = E.concentration(spark.createDataFrame(rows, "v string"), "v").first()
    assert (round(got.hhi, 6), got.top1, got.top3, got.singleton_ratio) == (0.36, 0.5, 0.9, 0.5)


def test_splits(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("label"), (F.col("id") % 10).alias("group"))
    dev = C.split_groups(df, "group", 0.25)
    sides = dev.groupBy("group").agg(F.count_distinct("dev").alias("n")).agg(F.max("n")).first()[0]
    assert sides == 1 and dev.where("dev").select("group").distinct().count() == 2 and dev.count() == 100
    folds = C.stratified_folds(df, "id", "label", 5)
    assert folds.count() == 100 and folds.select("fold").distinct().count() == 5
    held = C.holdout(spark.range(3).select("id", F.lit(1).alias("label")), "id", "label", 0.8)
    assert held.where("train").count() == 2


def test_keyed_writes(spark, tmp_path):
    from cathlight.sources import sinks

    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    path = f"file://{tmp_path}/t"
    assert sinks.insert_ignore(spark, path, rows, ["k"], "v") == (2, 1)
    assert sinks.insert_ignore(spark, path, spark.createDataFrame([(2, "x"), (3, "y")], "k long, v string"), ["k"], "v") == (1, 1)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "y")]
    new = sinks.replace_rows(spark, path, f"file://{tmp_path}/t2", spark.createDataFrame([(2, "z")], "k long, v string"), ["k"], "v")
    assert sorted(map(tuple, new.collect())) == [(1, "a"), (2, "z"), (3, "y")]


def test_losses_and_streak(spark):
    import math

    pairs = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 1.0)], "q int, i int, s double")
    assert abs(E.contrastive_loss(pairs, "q", "i", "s").first().loss - math.log(1 + math.exp(-1))) < 1e-12
    assert abs(E.sigmoid_loss(pairs, "q", "i", "s", 1.0, 0.0).first().loss - (math.log1p(math.exp(-1)) + math.log(2)) / 2) < 1e-12
    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate([3.0, 2.0, 2.5, 2.0, 1.0])], "g string, k int, v double")
    assert [(r.best, r.since) for r in E.streak(rows, "g", "k", "v").orderBy("k").collect()] == [(3.0, 0), (2.0, 0), (2.0, 1), (2.0, 2), (1.0, 0)]


def test_bootstrap(spark):
    df = spark.range(400).select(F.lit(1).alias("t"), (F.col("id") % 10 < 9).cast("int").alias("x"), (F.col("id") % 10 < 6).cast("int").alias("y"))
    got = E.bootstrap_delta(df, "t", "x", "y").first()
    assert abs(got.delta - 0.3) < 1e-12 and 0.2 < got.low < 0.28 and 0.32 < got.high < 0.4


def test_means_that_are_equal_on_paper_are_added_in_reading_order(spark, tmp_path):
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    from cathlight.operators import cohort as H
    from cathlight.plans import cohorts

    def mean(vs, i):
        total = 0.0  # not sum(), which compensates
        for v in vs:
            total += v[i]
        return total / len(vs)

    rng, files, rows = random.Random(6), 7, {}
    (tmp_path / "lineitem.parquet").mkdir()
    for f in range(files):
        own = [(k, rng.randrange(11) / 100, rng.randrange(9) / 100, float(rng.randrange(1, 51))) for k in range(300)] + ([(300, None, 0.5, 1.0)] if f else [])
        for k, *v in own:
            rows.setdefault(k, []).append(v)
        # the last files are the largest, so Spark reads them first
        table = pa.table({"l_orderkey": [r[0] for r in own], "l_discount": [r[1] for r in own], "l_tax": [r[2] for r in own], "l_quantity": [r[3] for r in own], "filler": [str(rng.random()) * f for _ in own]})
        pq.write_table(table, tmp_path / "lineitem.parquet" / f"{f}.parquet")
    want = {}
    for k, vs in rows.items():
        if k < 300:
            d, t, q = (mean(vs, i) for i in range(3))
            q /= 500
            want[k] = ("discount" if d >= t and d >= q else "tax" if t >= q else "quantity", round(max(d, t, q) - t, 9))
    read = spark.read.parquet(f"{tmp_path}/lineitem.parquet")
    for most in ("1kb", "128mb"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            got = {r.l_orderkey: (r.name, r.delta) for r in cohorts.best_feature_set(spark, str(tmp_path)).where("l_orderkey < 300").collect()}
            assert got == want
            means = {r.l_orderkey: r for r in H.means_as_read(read, "l_orderkey", ["l_discount", "l_tax"]).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert all((means[k].l_discount, means[k].l_tax) == (mean(vs, 0), mean(vs, 1)) for k, vs in rows.items() if k < 300)
        assert (means[300].l_discount, means[300].l_tax) == (None, 0.5)
