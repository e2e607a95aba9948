"""Readers of the archive's files: CSV and JSON Lines with explicit schemas, key/value metadata, binary files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def header(name: str) -> str:
    """A column name in lower case, with underscores."""
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def read_csv(spark: SparkSession, path: str, recursive: bool = False, required: list[str] | None = None, optional: list[str] | None = None, blank: str | None = "") -> DataFrame:
    """All cells as text under normalised headers; blank cells are `blank`, missing optional columns too.

    The header is read first, so nothing is inferred from the data. Files of one call share a header.
    """
    names = spark.read.option("recursiveFileLookup", recursive).csv(path, header=True, multiLine=True, escape='"').columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.option("recursiveFileLookup", recursive).schema(schema).csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    df = df.toDF(*[header(n) for n in names])
    lacking = [c for c in required or [] if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    for c in optional or []:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df if blank is None else df.na.fill(blank)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """accession_number and radrpt; blank accessions go, blank reports are null, the first of an accession stays."""
    df = read_csv(spark, path, required=["anon_acc", "radrpt"], blank=None).withColumn("_at", F.monotonically_increasing_id())
    own = df.select(F.nullif(F.trim("anon_acc"), F.lit("")).alias("accession_number"), F.nullif(F.trim("radrpt"), F.lit("")).alias("radrpt"), "_at").where("accession_number is not null")
    rank = F.row_number().over(Window.partitionBy("accession_number").orderBy("_at"))
    return own.withColumn("_rn", rank).where("_rn = 1").drop("_at", "_rn")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records that parse; blank and broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_jsonl_raw(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its text and, if it parses, its value as VARIANT."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("raw"), F.try_parse_json("value").alias("parsed"))


def pivot_metadata(rows: DataFrame, file_col: str, keys: list[str], key_col: str = "information", value_col: str = "value", order_col: str | None = None) -> DataFrame:
    """Key/value rows as one row a file; keys match in any case, the last of equal keys wins."""
    order = F.col(order_col) if order_col else F.monotonically_increasing_id()
    own = rows.select(file_col, F.lower(F.trim(key_col)).alias("_k"), F.trim(value_col).alias("_v"), order.alias("_o"))
    return own.groupBy(file_col).agg(*[F.max_by(F.when(F.col("_k") == k.lower(), F.col("_v")), F.when(F.col("_k") == k.lower(), F.col("_o"))).alias(header(k)) for k in keys])


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, directory, stem, length and time of files; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", F.regexp_replace("path", r"/[^/]*$", "").alias("directory"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), "length", "modificationTime")


def sequence_directories(listing: DataFrame) -> DataFrame:
    """Directories that own a frames folder with at least one image."""
    frames = listing.where(F.lower("directory").endswith("/frames") & F.lower("path").rlike(r"\.(png|jpe?g|tiff?|bmp)$"))
    return frames.groupBy(F.regexp_replace("directory", r"(?i)/frames$", "").alias("sequence_dir")).agg(F.count("*").alias("frames"))


def stem_index(listing: DataFrame) -> DataFrame:
    """One path for each stem, the first in path order."""
    return listing.groupBy("stem").agg(F.min("path").alias("path"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the JSON documents of a folder and its subfolders, one row a document."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return files.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def question_rows(df: DataFrame, text: str, uid: str = "sequence_instance_uid") -> DataFrame:
    """df without its text and with uid, question and answer: a row for each question of each sequence of a document; what isn't JSON gives none."""
    parsed = F.from_json(text, f"sequences array<struct<{uid}:string,qa:array<struct<question:string,answer:string>>>>")
    sequences = df.withColumn("_s", F.explode(parsed["sequences"])).drop(text)
    return sequences.withColumn("_q", F.explode("_s.qa")).withColumns({"uid": F.col(f"_s.{uid}"), "question": F.col("_q.question"), "answer": F.col("_q.answer")}).drop("_s", "_q")
