import pytest

from cathlight.plans import sql_tool
from cathlight.sources import tables
from cathlight.streaming import ingest


def test_reads_are_allowed(spark):
    spark.range(5).createOrReplaceTempView("t5")
    assert sql_tool.sql_tool(spark, "```sql\nWITH a AS (SELECT id FROM t5 WHERE id > 2) SELECT count(*) AS n FROM a ORDER BY n\n```")["rows"] == [{"n": 2}]
    assert "error" in sql_tool.sql_tool(spark, "SELECT nope FROM t5")
    got = sql_tool.sql_tool(spark, "SELECT upper(concat('a', x.id)) AS a, count(*) OVER (PARTITION BY x.id % 2) AS n FROM t5 x LATERAL VIEW explode(array(1)) e AS v WHERE x.id = (SELECT max(id) FROM t5)")
    assert got["rows"] == [{"a": "A4", "n": 1}]


@pytest.mark.parametrize("sql", ["DROP TABLE t5", "SET a=b", "CREATE TABLE x AS SELECT 1", "INSERT INTO t5 VALUES (1)", "CACHE TABLE t5"])
def test_writes_are_refused(spark, sql):
    with pytest.raises(PermissionError):
        sql_tool.run_sql(spark, sql)


@pytest.mark.parametrize("sql", [
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('java.lang.System', 'lineSeparator')", "SELECT id FROM t5 WHERE try_reflect('java.lang.Math', 'random') > '0'",
    "SELECT * FROM text.`/etc/passwd`", "SELECT (SELECT max(value) FROM csv.`/etc/passwd`)", "SELECT * FROM t5 WHERE id IN (SELECT 1 FROM parquet.`/tmp`)", "WITH a AS (SELECT * FROM json.`/etc/hosts`) SELECT * FROM a",
    "SELECT nobody_knows(id) FROM t5", "SELECT input_file_name() FROM t5", "SELECT * FROM sql_keywords()",
])
def test_code_and_paths_are_refused(spark, sql):
    spark.range(5).createOrReplaceTempView("t5")
    with pytest.raises(PermissionError):
        sql_tool.run_sql(spark, sql)


def test_long_results_are_cut(spark):
    spark.range(500).createOrReplaceTempView("t500")
    got = sql_tool.sql_tool(spark, "SELECT id FROM t500")
    assert got["row_count"] == 500 and len(got["rows"]) == 200


def test_chart():
    assert sql_tool.chart_spec("column", ["a", "b"], ["1", "x"]) == {"type": "bar", "title": "", "labels": ["a", "b"], "values": [1.0, 0.0]}


def test_csv_and_metadata(spark, tmp_path):
    (tmp_path / "r.csv").write_text('﻿Anon Acc #,radrpt\nA1,"two\nlines"\n,lost\nA1,again\nA2, \n', encoding="utf-8")
    got = sorted(map(tuple, tables.read_reports(spark, f"file://{tmp_path}/r.csv").collect()))
    assert got == [("A1", "two\nlines"), ("A2", None)]
    eav = spark.createDataFrame([("f", "Modality", "XA", 1), ("f", "modality", "CT", 2), ("g", "Frames", "3", 1)], "file string, information string, value string, n int")
    assert {tuple(r) for r in tables.pivot_metadata(eav, "file", ["Modality", "Frames"], order_col="n").collect()} == {("f", "CT", None), ("g", None, "3")}


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n\n{"a": 2}\n')
    assert tables.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", "a int").count() == 2
    assert tables.read_jsonl_raw(spark, f"file://{tmp_path}/x.jsonl").where("parsed is null").count() == 1


def test_resumable_ingestion(spark, tmp_path):
    source, target, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(source)
    for rows in ([(2, "z"), (3, "c")], []):
        ingest.ingest_available(spark, source, "k long, v string", target, state, ["k"], "v")
        if rows:
            spark.createDataFrame(rows, "k long, v string").write.mode("append").parquet(source)
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [(1, "a"), (2, "b"), (3, "c")]
