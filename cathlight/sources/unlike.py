"""CSV files that don't share a header: each is read whole in its own task, with a status, and the rows are united by name.

Files come through Spark's readers, so they may lie in any store. A file is one row while it is parsed, so it has to fit a task: these are metadata
files of a folder each, not tables.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARSED = "path string, status string, place int, header array<string>, cells array<string>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(content: bytes) -> tuple[str, list[list[str]]]:
        try:
            found = [r for r in csv.reader(io.StringIO(content.decode("utf-8-sig"), newline="")) if any(r)]
        except (UnicodeDecodeError, csv.Error) as e:
            return f"read_error:{'UnicodeDecodeError' if isinstance(e, UnicodeDecodeError) else 'ParserError'}", []
        if not found:
            return "read_error:EmptyDataError", []
        if any(len(r) > len(found[0]) for r in found):
            return "read_error:ParserError", []
        return "ok", found

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            status, found = rows(content)
            header, body = (found[0], found[1:]) if found else (None, [])
            body = [r + [""] * (len(header) - len(r)) for r in body] or [None]
            n = len(body)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * n), pa.array([status] * n), pa.array(range(n), pa.int32()), pa.array([header] * n, pa.list_(pa.string())), pa.array(body, pa.list_(pa.string()))], names=["path", "status", "place", "header", "cells"]
            )


def read_each(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(path, status, place, header, cells): a row for each row of every file below a folder, or one with null cells for a file that has none.

    status is ok or read_error: with EmptyDataError (no line at all), ParserError (a row longer than its header) or UnicodeDecodeError. Blank lines are skipped,
    a mark at the beginning of a file too; short rows are filled with blank cells.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    rows = found.select("path", "content").mapInArrow(_parsed, PARSED)
    # Spark reads no file of length 0; its list of names has them
    names = [(re.sub("^file:/+", "file:/", unquote(n)),) for n in found.inputFiles()]
    empty = spark.createDataFrame(names, "path string").join(found.select("path"), "path", "left_anti")
    none = lambda kind, c: F.lit(None).cast(kind).alias(c)
    return rows.unionByName(empty.select("path", F.lit("read_error:EmptyDataError").alias("status"), F.lit(0).alias("place"), none("array<string>", "header"), none("array<string>", "cells")))


def file_status(rows: DataFrame) -> DataFrame:
    """(path, status, rows) of each file."""
    return rows.groupBy("path").agg(F.max("status").alias("status"), F.count("cells").alias("rows"))


def united(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All rows of readable files, by the names of their columns (all that any file has, in name order, unless given), as text; null where a file lacks one. Of equal names in a header the first counts."""
    own = rows.where("status = 'ok' and cells is not null")
    if columns is None:
        columns = [r[0] for r in own.select(F.explode("header").alias("c")).distinct().orderBy("c").collect()]  # column names
    return own.select("path", "place", *(F.get(F.col("cells"), F.array_position("header", c).cast("int") - 1).alias(c) if c else F.lit(None).alias(c) for c in columns))


KEYS = ("StudyInstanceUID", "SOPInstanceUID", "AccessionNumber", "SeriesDate", "AcquisitionTime", "ContentDate")
# Other spellings of two keys, by their order of preference
ALIASES = {"AccessionNumber": ("AccessionNumber", "Accession Number", "Accession"), "SOPInstanceUID": ("SOPInstanceUID", "SOP Instance UID", "SOPInstanceUid")}
PLAIN_ALIASES = {"AccessionNumber": ("accessionnumber", "accession"), "SOPInstanceUID": ("sopinstanceuid",)}
LOWER_KEYS = {"AccessionNumber": "accession_number", "SOPInstanceUID": "sop_instance_uid"}


def _key_values(rows: DataFrame, named_only: bool) -> DataFrame:
    """(path, kv): a map of each file's two columns named information and value in any case, or its only two (its first two, unless named_only); the last of equal keys, none blank."""
    low = F.transform("header", lambda h: F.lower(F.trim(h)))
    named = F.array_contains(low, "information") & F.array_contains(low, "value")
    at = lambda name, other: F.when(named, F.array_position(low, name).cast("int") - 1).otherwise(other)
    fits = named | (F.size("header") == 2) if named_only else F.size("header") >= 2
    own = rows.where("status = 'ok' and cells is not null").where(fits)
    pairs = own.select("path", "place", F.trim(F.get("cells", at("information", 0))).alias("k"), F.trim(F.get("cells", at("value", 1))).alias("v")).where("k <> ''")
    last = pairs.groupBy("path", "k").agg(F.max_by("v", "place").alias("v"), F.min("place").alias("first"))
    listed = F.sort_array(F.collect_list(F.struct("first", "k", "v")))  # a file's keys
    return last.groupBy("path").agg(listed.alias("_kv")).select("path", F.map_from_entries(F.transform("_kv", lambda x: F.struct(x["k"], x["v"]))).alias("kv"))


def metadata_records(rows: DataFrame) -> DataFrame:
    """(path, KEYS): the distinct rows of files with a column SOPInstanceUID, and one row of each file of keys and values; what a file lacks is blank.

    Rows and files without a SOPInstanceUID have none. Files of keys may write the two lower-case names instead.
    """
    wide = united(rows.where(F.array_contains("header", "SOPInstanceUID")), list(KEYS)).drop("place").distinct().select("path", *(F.coalesce(F.trim(k), F.lit("")).alias(k) for k in KEYS))
    kv = _key_values(rows.where(~F.array_contains("header", "SOPInstanceUID")), True)
    value = lambda k: F.coalesce(F.nullif(F.element_at("kv", k), F.lit("")), F.element_at("kv", LOWER_KEYS[k]) if k in LOWER_KEYS else F.lit(None), F.lit(""))
    return wide.unionByName(kv.select("path", *(value(k).alias(k) for k in KEYS))).where("SOPInstanceUID <> ''")


def metadata_keys(rows: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """(folder, accession, sop, status) of the file in each folder, and of `folders` (a column folder) that have none.

    status is ok, missing_metadata_csv, metadata_read_error: with the kind, metadata_empty_or_bad_format (no row, or one column), or metadata_missing_accession or _sop with
    the first 20 keys. Exact spellings come first, then any without case, blanks and underscores; a blank cell hides the other spellings.
    """
    files = rows.groupBy("path").agg(F.max("status").alias("_read"), F.count("cells").alias("_rows"), F.max(F.size("header")).alias("_columns"))
    met = files.join(_key_values(rows, False), "path", "left").withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))

    def found(key: str) -> Column:
        loose = [F.get(F.map_values(F.map_filter("kv", lambda k, v: _plain(k) == a)), F.size(F.map_filter("kv", lambda k, v: _plain(k) == a)) - 1) for a in PLAIN_ALIASES[key]]
        return F.coalesce(*(F.element_at("kv", a) for a in ALIASES[key]), *loose)

    usable = lambda c: F.coalesce((c != "") & (F.lower(c) != "nan"), F.lit(False))
    acc, sop = found("AccessionNumber"), found("SOPInstanceUID")
    keys = F.concat(F.lit("(keys=['"), F.array_join(F.slice(F.coalesce(F.map_keys("kv"), F.array().cast("array<string>")), 1, 20), "', '"), F.lit("'])"))
    keys = F.when(F.coalesce(F.size(F.map_keys("kv")), F.lit(0)) < 1, "(keys=[])").otherwise(keys)
    status = F.when(F.col("_read") != "ok", F.concat(F.lit("metadata_"), "_read")).when((F.col("_rows") == 0) | (F.col("_columns") < 2), "metadata_empty_or_bad_format")
    status = status.when(~usable(acc), F.concat(F.lit("metadata_missing_accession"), keys)).when(~usable(sop), F.concat(F.lit("metadata_missing_sop"), keys)).otherwise("ok")
    told = met.select("folder", acc.alias("_acc"), sop.alias("_sop"), status.alias("status"))
    told = told.select("folder", *(F.when(F.col("status") == "ok", F.col(c)).alias(n) for c, n in (("_acc", "accession"), ("_sop", "sop"))), "status")
    if folders is None:
        return told
    none = folders.select("folder").distinct().join(told, "folder", "left_anti")
    return told.unionByName(none.select("folder", F.lit(None).cast("string").alias("accession"), F.lit(None).cast("string").alias("sop"), F.lit("missing_metadata_csv").alias("status")))


def _plain(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[ _]", "")
