"""Order over whole tables: ties that fill several ranges, nulls, repeated rows, empty tables."""

from pyspark.sql import functions as F

from cathlight.operators import order as O


def test_numbers_of_hot_keys_and_nulls(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 11).alias("k"))
    got = O.numbered(df.repartition(5), "k").collect()
    assert sorted(r.place for r in got) == list(range(1, 3001))
    keys = [r.k for r in sorted(got, key=lambda r: r.place)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert O._dealt(df, ("k",)).where("k = 7").groupBy("_part").count().count() > 1  # one key over several ranges
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_against_a_loop(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 5 != 0, F.col("id") % 13).alias("v"))
    total = 0
    for i, r in enumerate(sorted(O.running(df, F.desc("id"), sums={"s": "v"}).collect(), key=lambda r: -r.id)):
        total += r.v or 0
        assert (r.place, r.s) == (i + 1, total)
    assert r.s_total == total


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g string, o long, t string")
    assert O.numbered(none, "o").count() == 0 and O.running(none, "o", sums={"s": "o"}).count() == 0 and O.grouped_rows(none, "g", "o").count() == 0
    nodes, edges = O.graphs(none, "o", "g", {"a": "t"}, {})
    assert nodes.count() == 0 and edges.count() == 0


def test_groups_with_null_keys_and_orders(spark):
    rows = [("b", 1), (None, 2), ("a", None), ("b", 3), (None, 2), ("b", 1)]
    got = O.grouped_rows(spark.createDataFrame(rows, "g string, o long"), "g", "o").collect()
    assert sorted((r.group_place, r.row_place, r.g) for r in got) == [(1, 1, "b"), (1, 2, "b"), (1, 3, "b"), (2, 1, None), (2, 2, None), (3, 1, "a")]


def test_graph_of_cut_names(spark):
    rows = [(2, " x ", "n1", "abcdef"), (1, "x", "N/A", "abcxyz"), (3, "", "n2", "abc"), (4, "w", " n1 ", None), (5, None, "n3", "zzz")]
    nodes, edges = O.graphs(spark.createDataFrame(rows, "o long, l string, m string, t string"), "o", "l", {"m": "m", "t": "t"}, {"t": 3})
    found = {(r.graph, r.kind, r.name): (r.id, r.degree, r.size, r.full_text) for r in nodes.collect()}
    assert found == {("m", "left", "x"): (1, 1, 15, "x"), ("m", "left", "w"): (0, 1, 15, "w"), ("m", "right", "n1"): (10_000, 2, 16, "n1"), ("t", "left", "x"): (1, 1, 15, "x"), ("t", "right", "abc"): (20_000, 1, 14, "abcxyz")}
    assert sorted(map(tuple, edges.collect())) == [("m", 0, 10_000), ("m", 1, 10_000), ("t", 1, 20_000)]
