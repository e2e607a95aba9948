"""Writers: fixed-order CSV, keyed appends and upserts of Parquet tables, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.curate import append_new, upsert


def write_csv(df: DataFrame, path: str, fields: list[str], mode: str = "overwrite") -> None:
    """One folder of CSV files with the given columns; others are left out."""
    df.select(*fields).write.mode(mode).csv(path, header=True, escape='"')


def _existing(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(like.schema).parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def insert_ignore(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], order: str) -> tuple[int, int]:
    """Append the rows of new keys; how many were inserted and ignored."""
    target = _existing(spark, path, rows)
    fresh = append_new(rows.limit(0), rows, keys, F.asc(order)) if target is None else append_new(target.limit(0), rows.join(target.select(*keys), keys, "left_anti"), keys, F.asc(order))
    before = 0 if target is None else target.count()
    fresh.write.mode("append").parquet(path)
    inserted = spark.read.schema(rows.schema).parquet(path).count() - before
    return inserted, rows.count() - inserted


def replace_rows(spark: SparkSession, path: str, version: str, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Write the table with rows of known keys replaced under a new version folder, and return it."""
    target = _existing(spark, path, rows)
    (upsert(target, rows, keys, F.desc(order)) if target is not None else upsert(rows.limit(0), rows, keys, F.desc(order))).write.mode("overwrite").parquet(version)
    return spark.read.schema(rows.schema).parquet(version)


def vector_rows(frames: DataFrame, sequence: str, frame: str) -> DataFrame:
    """frames with ids like SEQUENCE_f000012."""
    return frames.withColumn("id", F.format_string("%s_f%06d", F.col(sequence), F.col(frame)))
