"""Quantiles against sorted lists, kept thresholds, and signed ranks against all sign patterns."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from cathlight.operators import quantiles as Q
from cathlight.operators import significance as G


def test_quantiles_of_odd_values(spark):
    rng = np.random.default_rng(1)
    odd = [0.0, -0.0, 5e-324, -5e-324, 2.2e-308, 1.7e308, -1.7e308, 1.0, 1.0 + 2**-52, 2.0, -2.0, float("inf"), -float("inf"), 3.0] * 2
    groups = {"odd": odd, "many": list(rng.standard_normal(500) * 10.0 ** rng.integers(-200, 200, 500)), "one": [7.5], "equal": [3.25] * 40, "close": [1 + k * 2**-52 for k in range(64)]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("odd", None), ("none", None), (None, 2.0), (None, 4.0)]
    ps = [0.0, 0.03, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.p): r.quantile for r in Q.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", ps, ["g"]).collect()}
    assert len(got) == len(ps) * (len(groups) + 1) and got[None, 0.5] == 3.0
    for g, vs in groups.items():
        vs = sorted(vs)
        for p in ps:
            at = p * (len(vs) - 1)
            a, b = vs[math.floor(at)], vs[min(math.floor(at) + 1, len(vs) - 1)]
            want = a if a == b else a + (b - a) * (at - math.floor(at))
            assert got[g, p] == want or (math.isnan(want) and math.isnan(got[g, p])), (g, p)
    assert Q.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).count() == 0


def test_keys_sort_as_their_doubles(spark):
    rng = np.random.default_rng(2)
    values = [float(x) for x in np.frombuffer(rng.bytes(8 * 4000), np.float64) if not math.isnan(x)] + [2.0**k for k in range(-1074, 1024, 7)] + [np.nextafter(2.0**k, 0) for k in range(-1000, 1024, 7)]
    got = [r[1] for r in sorted(spark.createDataFrame([(float(v),) for v in values], "v double").select("v", Q.ordered_key(F.col("v"))).collect(), key=lambda r: r[0])]
    assert got == sorted(got) and len(set(got)) == len(set(values))
    assert spark.createDataFrame([(float("nan"),), (float("inf"),)], "v double").select(Q.ordered_key(F.col("v"))).distinct().count() == 2


FRAMES = [("s1", "a", 5.0, 100.0, 0.5, 3.0), ("s1", "b", 2.0, 90.0, 0.25, 2.0), ("s2", "a", 4.0, 300.0, 0.99, 7.0), ("s2", "b", 4.0, 10.0, 0.1, 1.0), ("s3", "c", None, 1.0, 1.0, 1.0)]


def test_thresholds_are_kept_while_their_frames_are(spark, tmp_path):
    df = spark.createDataFrame(FRAMES, "sequence string, frame string, std double, mean double, bright_frac double, entropy double")
    folder, calls = str(tmp_path / "thresholds"), []

    def learn(*a):
        calls.append(1)
        return Q.thresholds(*a)

    first, kept = Q.kept_thresholds(df, "sequence", "frame", folder, learn)
    want = {"MASK_MAX_STD": 4.6, "MASK_MAX_MEAN": 255.0, "MASK_MIN_MEAN": 92.87 * 1.0, "MASK_MAX_BRIGHT_FRAC": 1.0, "MASK_MAX_ENTROPY": 8.05}
    want["MASK_MIN_MEAN"] = round((90 + 210 * 0.03) / 1.15, 2)
    assert not kept and {r.name: r.value for r in first.collect()} == want
    again, kept = Q.kept_thresholds(df.orderBy(F.rand()), "sequence", "frame", folder, learn)
    assert kept and {r.name: r.value for r in again.collect()} == want and len(calls) == 1
    _, kept = Q.kept_thresholds(df.withColumn("mean", F.col("mean") + 1), "sequence", "frame", folder, learn)
    assert not kept and len(calls) == 2
    for broken in ('{"name":"MASK_MAX_STD","value":"x"}', "not json"):
        for f in (tmp_path / "thresholds").glob("part-*"):
            f.write_text(broken)
        for f in (tmp_path / "thresholds").glob(".*.crc"):
            f.unlink()
        assert not Q.kept_thresholds(df, "sequence", "frame", folder, learn)[1]
    assert len(calls) == 4


def test_signed_ranks_against_all_signs(spark):
    rng = np.random.default_rng(3)
    groups = {f"g{k}": [float(x) for x in rng.permutation(np.arange(1, n + 1)) * rng.choice([-1, 1], n)] for k, n in enumerate((1, 2, 5, 9, 12))}
    rows = [(g, d) for g, ds in groups.items() for d in ds] + [("zeros", 0.0), ("zeros", 0.0), ("none", None)]
    got = {r.g: r for r in G.wilcoxon(spark.createDataFrame(rows, "g string, d double"), "g", "d").collect()}
    for g, ds in groups.items():
        n = len(ds)
        least = min(sum(abs(d) for d in ds if d > 0), sum(abs(d) for d in ds if d < 0))
        sums = [sum(k for k, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
        assert got[g].statistic == least and abs(got[g].p_wilcoxon - min(1.0, 2 * sum(s <= least for s in sums) / 2**n)) < 1e-12
    assert (got["zeros"].n, got["zeros"].zeros, got["zeros"].p_wilcoxon, got["zeros"].statistic) == (0, 2, None, None) and "none" not in got


def test_signed_ranks_of_large_and_small_groups(spark, monkeypatch):
    rng = np.random.default_rng(7)
    groups = {k: [float(x) for x in rng.integers(-6, 7, n)] for k, n in (("a", 3), ("b", 60), (None, 50), ("c", 9), ("d", 200))} | {"zeros": [0.0] * 30}
    df = spark.createDataFrame([(k, d) for k, ds in groups.items() for d in [*ds, None]], "g string, d double")
    for most in (0, 20, 1000):
        monkeypatch.setattr(G, "ALONE", most)
        got = {r.g: r for r in G.signed_ranks(df, "g", "d").collect()}
        assert set(got) == set(groups)
        for k, ds in groups.items():
            sizes = sorted(abs(d) for d in ds if d)
            rank = {x: sizes.index(x) + (sizes.count(x) + 1) / 2 for x in sizes}
            counts = [sizes.count(x) for x in rank]
            want = (len(sizes), ds.count(0.0), sum(c > 1 for c in counts), sum(rank[d] for d in ds if d > 0), sum(rank[-d] for d in ds if d < 0), sum(c**3 - c for c in counts))
            assert (got[k].n, got[k].zeros, got[k].ties, got[k].plus, got[k].minus, got[k].tied_cubes) == want, (k, most)


def test_p_values_of_many_groups_are_not_folded_group_by_group(spark):
    df = spark.range(60).select(F.col("id") % 3, F.lit(1).alias("one"), F.rand(1).alias("w"), F.rand(2).alias("o")).toDF("m", "one", "w", "o")
    plan = G.paired_tests(df, "m", "w", "o", "one")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "ArrowEvalPython" in plan


def test_millions_of_pairs(spark):
    n = 1_800_000  # n (n + 1) (2 n + 1) is beyond a long
    d = F.when(F.col("id") % 1000 < 499, -1.0).otherwise(1.0)
    r = G.paired_tests(spark.range(n).select(F.lit("m").alias("m"), F.lit(1).alias("one"), d.alias("w"), F.lit(0.0).alias("o")), "m", "w", "o", "one").first()
    down, mean = n * 499 // 1000, (n + 1) / 2
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (n**3 - n) / 48)
    assert r.n_pairs == n and r.statistic == down * mean and abs(r.p_wilcoxon - math.erfc((n * (n + 1) / 4 - down * mean) / spread / math.sqrt(2))) < 1e-6
    assert abs(r.p_ttest - math.erfc(r.t / math.sqrt(2))) < 1e-5  # so many pairs: as good as normal


def test_incomplete_beta_and_gamma(spark):
    rows = [(a, b, x) for a in (0.5, 1.0, 3.5, 40.0, 500.0) for b in (0.5, 2.0) for x in (0.0, 0.1, 0.5, 0.9, 0.999, 1.0)]
    for r in spark.createDataFrame(rows, "a double, b double, x double").select("*", G.incomplete_beta(F.col("a"), F.col("b"), F.col("x")).alias("i"), G.log_gamma(F.col("a")).alias("g")).collect():
        assert abs(r.g - math.lgamma(r.a)) < 1e-9
        # the integral after t = sin(u)^2, by Simpson's rule
        top, n = math.asin(math.sqrt(r.x)), 4000
        f = lambda u: 2 * math.sin(u) ** (2 * r.a - 1) * math.cos(u) ** (2 * r.b - 1) if 0 < u < math.pi / 2 or min(r.a, r.b) >= 0.5 else 0.0
        area = sum((1 if k in (0, n) else 4 if k % 2 else 2) * f(top * k / n) for k in range(n + 1)) * top / n / 3
        assert abs(r.i - area / math.exp(math.lgamma(r.a) + math.lgamma(r.b) - math.lgamma(r.a + r.b))) < 1e-6, r


def test_tiles_of_odd_shapes(spark):
    from cathlight.functions import tiles as I

    dark, spot = [0.0] * 12, [0.0] * 5 + [9.0, 0.0, 0.0, 0.0, 8.0, 0.0, 0.0]
    df = spark.createDataFrame([(1, dark), (2, spot), (3, []), (4, None), (5, [200.0, None, 240.0, 300.0])], "id long, p array<double>")
    p, w = F.col("p"), F.lit(4)
    got = {r.id: r for r in df.select("id", I.bounding_box(p, w, 5).alias("b"), I.border_runs(p, w, 5).alias("r"), I.trimmed(p, w, 5).alias("t"), I.active_statistics(p).alias("s"), I.cropped_statistics(p, w, 0.3).alias("c"), I.windowed(p, F.lit(0.0), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(True)).alias("l")).collect()}
    assert got[1].b is None and tuple(got[1].r) == (3, 3, 4, 4) and got[1].t.pixels == dark and got[1].s is None and got[1].l == [255] * 12
    assert tuple(got[2].b) == (1, 2, 1, 1) and tuple(got[2].r) == (1, 0, 1, 2) and (got[2].t.width, got[2].t.height, got[2].t.pixels) == (1, 2, [9.0, 8.0]) and tuple(got[2].c) == (4.5, 0.0) and got[2].l[5] == 0
    assert got[3].b is None and got[3].s is None and got[4].b is None and got[4].s is None
    assert (got[5].s.active_frac, got[5].s.bright_frac, got[5].s.entropy) == (0.75, 2 / 3, 1.0) and abs(got[5].s.std - np.std([200, 240, 300])) < 1e-9


def test_bootstrap_against_full_resampling(spark):
    from cathlight.operators import evaluate as E

    rng = np.random.default_rng(4)
    truth, a, b = rng.integers(0, 2, 300), rng.integers(0, 2, 300), rng.integers(0, 2, 300)
    a = np.where(rng.random(300) < 0.4, truth, a)
    df = spark.createDataFrame([tuple(map(int, r)) for r in zip(truth, a, b)] + [(None, 1, 0)], "t int, a int, b int")
    got = E.bootstrap_delta(df, "t", "a", "b", seed=5).first()
    d = (a == truth).astype(int) - (b == truth).astype(int)
    full = d[rng.integers(0, 300, (4000, 300))].mean(axis=1)
    assert got.n == 300 and got.delta == d.mean() and abs(got.mean_delta - full.mean()) < 0.004 and abs(got.low - np.quantile(full, 0.025)) < 0.015 and abs(got.high - np.quantile(full, 0.975)) < 0.015 and got.significant == "Yes"
    assert tuple(got) == tuple(E.bootstrap_delta(df.repartition(7), "t", "a", "b", seed=5).first()) and got.low != E.bootstrap_delta(df, "t", "a", "b", seed=6).first().low
    same = E.bootstrap_delta(df.where("a = t"), "t", "a", "a").first()
    assert (same.delta, same.mean_delta, same.low, same.high, same.significant) == (0.0, 0.0, 0.0, 0.0, "No") and E.bootstrap_delta(df.limit(0), "t", "a", "b").count() == 0
    sure = E.bootstrap_delta(df.where("a = t").withColumn("b", 1 - F.col("t")), "t", "a", "b").first()
    assert (sure.delta, sure.mean_delta, sure.low, sure.high) == (1.0, 1.0, 1.0, 1.0)
