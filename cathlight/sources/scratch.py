"""Frames cut off from their lineage, in the folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, in spark.checkpoint.dir; a local folder only where none is set on a local master."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cathlight-"))
    return df.checkpoint()


def folder_for(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir for tables of a run; a local one only where none is set on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set")
    return f"file://{tempfile.mkdtemp(prefix='cathlight-')}"
