"""Stages with a manifest: break, resume, what goes stale."""

import json

import pytest
from pyspark.sql import functions as F

from cathlight.operators import stages as G


def test_a_broken_stage_blocks_only_what_needs_it_and_is_resumed(spark, tmp_path):
    folder, calls, broken = str(tmp_path / "run"), [], [True]

    def double(numbers, by):
        calls.append("double")
        return numbers.withColumn("x", F.col("x") * by)

    def fragile(numbers):
        calls.append("fragile")
        if broken:
            raise RuntimeError("no disk\nmore")
        return numbers.where("x > 1")

    def total(double):
        calls.append("total")
        return double.agg(F.sum("x").alias("s"))

    def both(fragile, total):
        calls.append("both")
        return fragile.join(total)

    spark.range(4).select(F.col("id").alias("x")).write.parquet(str(tmp_path / "numbers"))
    tables = lambda: {"numbers": spark.read.parquet(str(tmp_path / "numbers"))}
    stages = lambda by: [G.Stage("double", ("numbers",), double, {"by": by}), G.Stage("fragile", ("numbers",), fragile), G.Stage("total", ("double",), total), G.Stage("both", ("fragile", "total"), both)]
    run = lambda by=2: {k: v["status"] for k, v in G.run_stages(spark, stages(by), tables(), folder).items()}

    assert run() == {"double": "done", "fragile": "failed", "total": "done", "both": "blocked"} and calls == ["double", "fragile", "total"]
    assert G.read_manifest(spark, folder)["fragile"]["error"] == "no disk"
    with pytest.raises(ValueError):
        G.output(spark, folder, "both")
    broken.clear()
    calls.clear()
    assert run() == {"double": "kept", "fragile": "done", "total": "kept", "both": "done"} and calls == ["fragile", "both"]
    calls.clear()
    assert set(run().values()) == {"kept"} and not calls and G.output(spark, folder, "total").first().s == 12
    assert run(3) == {"double": "done", "fragile": "kept", "total": "done", "both": "done"} and G.output(spark, folder, "total").first().s == 18
    spark.range(1).select(F.lit(100).cast("long").alias("x")).write.mode("append").parquet(str(tmp_path / "numbers"))
    assert set(run(3).values()) == {"done"} and G.output(spark, folder, "both").count() == 3
    (tmp_path / "run" / "manifest.json").write_text("{broken")
    (tmp_path / "run" / ".manifest.json.crc").unlink(missing_ok=True)
    assert set(run(3).values()) == {"done"}
    assert [json.loads(x)["name"] for x in (tmp_path / "run" / "manifest.json").read_text().splitlines()] == ["double", "fragile", "total", "both"]


def test_unknown_inputs_are_told_before_anything_runs(spark, tmp_path):
    for stages in ([G.Stage("a", ("b",), lambda b: b), G.Stage("b", ("t",), lambda t: t)], [G.Stage("t", (), lambda: None)]):
        with pytest.raises(ValueError):
            G.run_stages(spark, stages, {"t": spark.range(1)}, str(tmp_path))
    assert not G.read_manifest(spark, str(tmp_path))
