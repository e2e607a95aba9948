"""The corpus pipeline: toxicity, quality rules, near duplicates, repeated strings, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a frame
that is written as Parquet and read again as the next one's docs. All but the last return the columns
of documents; a text that a stage has cut gets a new n_chars. Rows with a null doc_id pass through the
filters by the same verdicts, and are never near duplicates. Of rows with one doc_id (or none) and one text,
the near-duplicate stage keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cathlight.llm import near_dedup, packing, quality_rules, suffix_dedup, toxicity
from cathlight.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7."""
    return toxicity.scored(docs, toxicity.model_of(spark, sf_dir, docs)).where("score < 0.7").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    rules = quality_rules.learned_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, rules)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one of the smallest id, once."""
    out = near_dedup.near_duplicates(docs, shingle=5, percent=80)
    return out.where("kept or doc_id is null").select(*docs.columns).dropDuplicates(["doc_id", "text"])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 100-byte strings; a document of which nothing is left goes.

    A cut may fall inside a character; what is left of it is dropped.
    """
    out = suffix_dedup.suffix_dedup(docs, as_text=True)
    whole = F.col("n_removed") == 0
    cut = out.withColumns({"text": F.when(whole, F.col("text")).otherwise(F.col("kept_text")), "n_chars": F.when(whole, F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))})
    return cut.where("n_removed = 0 or text <> ''").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 1024."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [("toxicity", drop_toxic), ("quality rules", keep_quality), ("near duplicates", drop_near_duplicates), ("repeated strings", cut_repeats), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
