"""Named stages over tables, with a manifest after each step: what is up to date is kept, what fails stops only what needs it.

A stage's mark covers its settings and the marks of its inputs: for a table the names, lengths and times of its files (its rows, where it
has no files), for a stage its own mark. Output goes to a folder of that mark, so an old one stays until the new one is whole. The manifest is written
beside the old one and renamed into its place, so it can be read at any time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .quantiles import fingerprint

DONE = ("done", "kept")


@dataclass(frozen=True)
class Stage:
    """A name, the tables and earlier stages it reads, and a function of those frames (by name) and its settings."""

    name: str
    inputs: tuple[str, ...]
    make: Callable[..., DataFrame]
    settings: dict = field(default_factory=dict)


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def table_mark(df: DataFrame) -> str:
    """Of the files a frame reads, and its columns; of its rows if it reads none."""
    spark, told = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        store, path = _store(spark, name)
        status = store.getFileStatus(path)
        told.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return "\n".join([*told, df.schema.json()]) if told else fingerprint(df)


def read_manifest(spark: SparkSession, folder: str) -> dict[str, dict]:
    """What each stage's last run left: status, mark, rows, path, error; empty without a manifest that can be read."""
    store, path = _store(spark, f"{folder}/manifest.json")
    if not store.exists(path):
        return {}
    lines = [r.value for r in spark.read.text(f"{folder}/manifest.json").collect()]  # a line a stage
    try:
        return {entry["name"]: entry for entry in map(json.loads, lines)}
    except (ValueError, KeyError, TypeError):
        return {}


def _write_manifest(spark: SparkSession, folder: str, manifest: dict[str, dict]) -> None:
    store, fresh = _store(spark, f"{folder}/manifest.json.new")
    out = store.create(fresh, True)
    out.write("\n".join(json.dumps(e, sort_keys=True) for e in manifest.values()).encode())
    out.close()
    _, path = _store(spark, f"{folder}/manifest.json")
    store.delete(path, False)
    store.rename(fresh, path)


def run_stages(spark: SparkSession, stages: list[Stage], tables: dict[str, DataFrame], folder: str) -> dict[str, dict]:
    """Run the stages in the order given; the manifest.

    done: made now. kept: its mark and output are those of an earlier run. failed: it raised, and the error's first line is kept. blocked: a stage it
    reads is failed or blocked. Everything else goes on. A name used twice, or an input that is neither a table nor an earlier stage, is an error before anything runs.
    """
    known = set(tables)
    for s in stages:
        if s.name in known or not set(s.inputs) <= known:
            raise ValueError(f"stage {s.name}: its name is taken or an input is unknown")
        known.add(s.name)
    before = read_manifest(spark, folder)
    manifest = {k: v for k, v in before.items() if k not in {s.name for s in stages}}
    marks: dict[str, str] = {}
    for s in stages:
        needs = [i for i in s.inputs if i not in tables]
        if any(manifest[i]["status"] not in DONE for i in needs):
            manifest[s.name] = {"name": s.name, "status": "blocked"}
            _write_manifest(spark, folder, manifest)
            continue
        for i in s.inputs:
            if i not in marks:
                marks[i] = manifest[i]["mark"] if i in manifest and i not in tables else table_mark(tables[i])
        text = json.dumps([s.name, sorted((k, repr(v)) for k, v in s.settings.items()), [marks[i] for i in s.inputs]])
        mark = hashlib.sha256(text.encode()).hexdigest()[:16]
        path, old = f"{folder}/{s.name}/{mark}", before.get(s.name, {})
        store, success = _store(spark, f"{path}/_SUCCESS")
        if old.get("mark") == mark and old.get("status") in DONE and store.exists(success):
            manifest[s.name] = {**old, "status": "kept"}
        else:
            try:
                frames = {i: tables[i] if i in tables else spark.read.parquet(manifest[i]["path"]) for i in s.inputs}
                s.make(**frames, **s.settings).write.mode("overwrite").parquet(path)
                manifest[s.name] = {"name": s.name, "status": "done", "mark": mark, "path": path, "rows": spark.read.parquet(path).count()}
            except Exception as e:  # whatever a stage raises is its result
                manifest[s.name] = {"name": s.name, "status": "failed", "mark": mark, "error": (str(e).splitlines() or [type(e).__name__])[0][:500]}
        _write_manifest(spark, folder, manifest)
    return manifest


def output(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """What a stage made last."""
    entry = read_manifest(spark, folder).get(name, {})
    if entry.get("status") not in DONE:
        raise ValueError(f"stage {name} is not done")
    return spark.read.parquet(entry["path"])
