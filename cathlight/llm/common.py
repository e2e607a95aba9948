"""Shared pieces of the training-data operators: table access, scratch tables, components."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once a context."""
    context = spark.sparkContext
    if not getattr(context, "_cathlight_shipped", False):
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "cathlight"), "zip", top, "cathlight"))
        context._cathlight_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a fresh one on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"cathlight-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


class Scratch:
    """Parquet tables in the shared folder, which cut lineage and survive lost executors.

    A table that the returned frame still reads stays; drop() removes the others as soon as
    what was derived from them has been written.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.top = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b).

    Large-star and small-star steps alternate until the edges stay as they are; every step is a
    grouped minimum and a join, so no component is ever gathered in one place.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.join(low, "a")
        if large:
            out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        out = out.where("a <> b")
        return out if large else out.distinct()

    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = scratch.write(down)
    seen = sign(edges)
    while seen[0]:
        after = scratch.write(star(star(edges, True), False))
        scratch.drop(edges)
        edges, before, seen = after, seen, sign(after)
        if seen == before:
            break
    out = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out._scratch_path = edges._scratch_path
    return out
