import random
import re

from pyspark.sql import functions as F

from cathlight.functions import nested as N
from cathlight.functions import text as T
from cathlight.operators import cohort as H
from cathlight.operators import probes as B
from cathlight.operators import records as R
from cathlight.sources import tables


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t"))).collect()]


def test_leaves(spark):
    got = one(spark, N.leaf_counts, '{"a":[],"b":{"c":null,"d":"other","e\\":":"x:\\"y\\""},"f":[1,-2.5e3,true],"g":{}}', "[]", "{}", '"unknown"', "no", "", None)
    assert [g and tuple(g) for g in got] == [(7, 3), (1, 1), (0, 0), (1, 1), None, None, None]


def test_degenerate(spark):
    hollow = '{"title":" Untitled ","year":null,"a":[null,null,"other","unknown",[],null]}'
    full = '{"title":"untitled","a":["x","y"]}'
    said_no = '{"title":"untitled","adherence":{"1":{"adherence":" no"},"2":{"adherence":"NO"}},"x":[1,2,3]}'
    assert one(spark, N.degenerate, hollow, full, said_no, None) == [True, False, False, False]
    assert one(spark, N.checklist_degenerate, hollow, full, said_no, '{"title":"untitled","adherence":{}}')[:3] == [True, False, True]


def test_paths_and_lists(spark):
    assert one(spark, N.boolean_paths, '{"a":true,"b":{"c":{"d":false}},"l":[true]}', "[true]", "x", None) == [{"a": True, "b.c.d": False}, {}, None, None]
    pick = lambda c: F.to_json(N.found_list(c, ["sequences"]))
    assert one(spark, pick, '["a"]', '{"z":["q"],"sequences":[{"k":1}]}', '{"z":["q"],"n":[1]}', '{"n":[]}', "x", None) == [
        '{"path":"$","items":["a"]}', '{"path":"$.sequences","items":["{\\"k\\":1}"]}', '{"path":"$.z","items":["q"]}', None, None, None]
    assert one(spark, N.lenient_object, '{"a":1}', 'so: {"a":{"b":2}} end', "[1]", '{"a":', "", None) == ['{"a":1}', '{"a":{"b":2}}', None, None, None, None]


def test_text_chain(spark):
    assert one(spark, T.expand_abbreviations, "80% lad; s/p PCI w/ DES", "LV gram, then LV", "6F and 2 wk", None) == [
        "80% left anterior descending; status post percutaneous coronary intervention with drug-eluting stent",
        "left ventriculogram, then left ventricular", "6 French (catheter size) and 2 week", None]
    raw = "noise\nFINDINGS - 80% LAD Lesion. IT is Calm\nimpression:\nStable.\nElectronically signed by X"
    assert one(spark, T.finished_report, raw) == ["FINDINGS: 80% left anterior descending lesion. IT is calm\n\nIMPRESSION: stable."]
    assert one(spark, T.generated_text, 'Rephrased Report: "a  b"', "'", "'x\"", None) == ["a b", "'", "'x\"", ""]
    assert one(spark, T.sliced_or_whole, "FINDINGS: short", None) == ["FINDINGS: short", ""]


def merged(rows):
    """The plain loop: a record falls to the kept one with its DOI, else to the one with its title."""
    kept, by_doi, by_title = {}, {}, {}
    for o, doi, title, source in rows:
        d, t = (doi or "").strip().lower(), re.sub(r"[^a-z0-9 ]", "", (title or "").strip().lower())
        head = by_doi.get(d) if d else None
        head = head if head is not None else by_title.get(t) if t else None
        if head is None:
            kept[o] = source
            by_doi |= {d: o} if d else {}
            by_title |= {t: o} if t else {}
        else:
            kept[head] += ", " + source
    return kept


def test_merge_records(spark):
    draw = random.Random(3)
    for size, dois, titles in ((0, 1, 1), (60, 20, 15), (200, 90, 90)):
        rows = [(i, draw.choice([None, " ", f"10.1/{draw.randrange(dois)} ", f" 10.1/{draw.randrange(dois)}"]), draw.choice([None, f"A: {draw.randrange(titles)}", f"a {draw.randrange(titles)}!"]), f"s{i % 3}") for i in range(size)]
        df = spark.createDataFrame(rows, "o int, doi string, title string, source string")
        assert {r["o"]: r["merged"] for r in R.merge_records(df, "o", "doi", "title", "source").collect()} == merged(rows)


def test_match_template(spark):
    df = spark.createDataFrame([("is there a stent",), ("is there any stent",), ("zzz",), (None,), ("is there a stent",)], "q string")
    got = sorted(((r["q"] or "", r["match"], r["strategy"]) for r in R.match_template(df, "q", ["is there a stent", "which artery"], 0.8).collect()))
    assert got == [("", None, "none"), ("is there a stent", "is there a stent", "exact"), ("is there a stent", "is there a stent", "exact"), ("is there any stent", "is there a stent", "fuzzy"), ("zzz", None, "none")]


def test_json_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text('{"sequences":[\n{"sequence_instance_uid":"1.2","qa":[{"question":"q1","answer":"yes"},{"question":"q2"}]},{"qa":[]}]}')
    (tmp_path / "sub" / "b.json").write_text("broken")
    (tmp_path / "c.txt").write_text("x")
    docs = tables.json_documents(spark, str(tmp_path))
    assert {r["file"] for r in docs.collect()} == {"a.json", "b.json"}
    assert sorted(tuple(r) for r in tables.question_rows(docs, "text").collect()) == [("a.json", "1.2", "q1", "yes"), ("a.json", "1.2", "q2", None)]


def test_pools_of_odd_rows(spark):
    frames = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", None)], "g string, v array<double>")
    got = {(r["g"], r["at"]): r["value"] for r in R.attention_pool(frames, "g", "v", F.array(F.lit(1.0), F.lit(0.0)), 1.0).collect()}
    assert set(got) == {("a", 0), ("a", 1)} and abs(got["a", 0] / got["a", 1] - 2.718281828) < 1e-6
    rows = spark.createDataFrame([("a", 1, None, 1.0), ("a", 2, 5.0, 1.0), ("a", 3, 5.0, 1.0)], "g string, k int, x double, y double")
    labels = {r["k"]: (r["score"], r["label"]) for r in R.informative(rows, "g", "k", {"x": 1.0}, F.col("x") < 1, 10).collect()}
    assert labels == {1: (None, "uninformative"), 2: (0.0, "informative"), 3: (0.0, "uninformative")}


def test_frame_window(spark):
    rows = spark.createDataFrame([("3", "2", "9"), ("0", "5", "2"), (None, "x", " 4 "), ("1", None, None)], "b string, f string, l string")
    pick = lambda mode: [tuple(r[0]) for r in rows.select(H.frame_window(F.col("b"), F.col("f"), F.col("l"), mode)).collect()]
    assert pick("fl") == [(True, 2, 1, 8), (False, -1, -1, -1), (False, -1, -1, 3), (False, 0, -1, -1)]
    assert [r[0] for r in pick("best")] == [True, False, False, True] and all(r[0] for r in pick("none"))


def test_probe(spark):
    draw = random.Random(5)
    rows = [(i, f"g{i % 12}", [draw.gauss(2.0 * (i % 2), 1.0), draw.gauss(0, 1)], i % 2) for i in range(240)] + [(900, None, [1.0, 1.0], 1), (901, "g1", None, 1), (902, "g1", [1.0, 1.0], None)]
    df = spark.createDataFrame(rows, "i int, g string, x array<double>, y int")
    got = B.out_of_fold(df, "x", "y", "g", 4)
    held = got.collect()
    assert len(held) == 240 and all(len({r["fold"] for r in held if r["g"] == g}) == 1 for g in {r["g"] for r in held})
    report = B.probe_report(got, "y", []).first()
    assert report["n"] == 240 and 0.75 < report["accuracy"] < 0.95 and abs(report["balanced"] - report["accuracy"]) < 0.02
    alike = B.out_of_fold(df.where("y = 1"), "x", "y", "g", 4).collect()
    assert {r["predicted"] for r in alike} == {1} and B.out_of_fold(df.limit(0), "x", "y", "g", 4).count() == 0
