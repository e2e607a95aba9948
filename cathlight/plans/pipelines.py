"""Pipelines of stages over the given tables; they join the catalogue's."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curate as C
from ..operators import records as R
from ..operators import review as W
from ..operators import stages as G
from ..sources import unlike as U
from ..sources.scratch import cut, folder_for
from .catalog import query, read


def cleaned(documents: DataFrame, least: int) -> DataFrame:
    """Reports with their cleaned text, those of at least so many characters."""
    return documents.select("doc_id", "source", "lang", T.clean_report(F.col("text")).alias("text")).where(F.length("text") >= least)


def covered(cleaned: DataFrame, labels: DataFrame) -> DataFrame:
    return C.overlap(cleaned.select("doc_id"), labels.select("doc_id"), "doc_id")


def gates(column: Column, low: int, high: int) -> Column:
    """pass, fail or uncertain by a number; null without one."""
    return F.when(column < low, "fail").when(column < high, "uncertain").when(column.isNotNull(), "pass")


def screened(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents through two gates, by length and by quality."""
    met = documents.join(labels, "doc_id", "left")
    exclusion = F.when(F.col("quality") == 1, "Pass").when(F.col("quality") == 0, "fail").when(F.col("doc_id") % 7 == 0, "uncertain")
    return W.screen(met.select("doc_id", gates(F.col("n_chars"), 300, 400).alias("inclusion"), exclusion.alias("exclusion")))


def studies(lineitem: DataFrame) -> DataFrame:
    """A row a study: its instances, and the least key that stands for it."""
    return lineitem.groupBy("l_orderkey").agg(F.count("*").alias("instances"), F.min("l_partkey").alias("least"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"))


def funnel(screened: DataFrame, studies: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Counts of the other stages in the order of a layout."""
    counts = (
        cleaned.agg(F.lit("reports").alias("stage"), F.lit("cleaned").alias("metric"), F.count("*").alias("sequences"), F.sum(F.length("text")).alias("frames"))
        .unionByName(screened.groupBy(F.lit("screening").alias("stage"), F.lower("decision").alias("metric")).agg(F.count("*").alias("sequences"), F.lit(None).cast("long").alias("frames")))
        .unionByName(studies.agg(F.lit("studies").alias("stage"), F.lit("grouped").alias("metric"), F.count("*").alias("sequences"), F.sum("instances").alias("frames")))
    )
    return R.funnel_rows(counts, [("studies", "grouped"), ("reports", "cleaned"), ("screening", "include")])


STAGES = [
    G.Stage("cleaned", ("documents",), cleaned, {"least": 100}), G.Stage("covered", ("cleaned", "labels"), covered), G.Stage("screened", ("documents", "labels"), screened),
    G.Stage("studies", ("lineitem",), studies), G.Stage("funnel", ("screened", "studies", "cleaned"), funnel),
]


def run(spark: SparkSession, d: str, folder: str) -> dict[str, dict]:
    """All stages over the tables of a folder; what an earlier run left there and still holds is kept."""
    return G.run_stages(spark, STAGES, {t: read(spark, d, t) for t in ("documents", "labels", "lineitem")}, folder)


_GATES = """g AS (SELECT doc_id, CASE WHEN n_chars < 300 THEN 'fail' WHEN n_chars < 400 THEN 'uncertain' WHEN n_chars IS NOT NULL THEN 'pass' END AS i, CASE WHEN quality = 1 THEN 'pass' WHEN quality = 0 THEN 'fail' WHEN doc_id % 7 = 0 THEN 'uncertain' END AS e FROM documents LEFT JOIN labels USING (doc_id)),
  s AS (SELECT doc_id, CASE WHEN i IS NULL THEN 'ERROR' WHEN i = 'uncertain' THEN 'UNCERTAIN' WHEN i = 'fail' THEN 'EXCLUDE' WHEN e IS NULL THEN 'ERROR' WHEN e = 'uncertain' THEN 'UNCERTAIN' WHEN e = 'pass' THEN 'INCLUDE' ELSE 'EXCLUDE' END AS decision,
    CASE WHEN coalesce(i <> 'pass', true) OR coalesce(e = 'uncertain', false) THEN 'inclusion' WHEN coalesce(e <> 'pass', true) THEN 'exclusion' END AS failed_at FROM g)"""


@query(f"WITH {_GATES} SELECT decision, failed_at, decision IN ('UNCERTAIN', 'ERROR') AS flagged, count(*) AS n FROM s GROUP BY ALL")
def screened_documents(spark, d):
    return screened(read(spark, d, "documents"), read(spark, d, "labels")).groupBy("decision", "failed_at", "flagged").agg(F.count("*").alias("n"))


@query(f"""WITH {_GATES}, m AS (SELECT DISTINCT lower(decision) AS metric FROM s)
  SELECT 'covered' AS name, 'done' AS status, 1::BIGINT AS n UNION ALL SELECT 'screened', 'done', count(*) FROM s UNION ALL SELECT 'studies', 'done', count(DISTINCT l_orderkey) FROM lineitem
  UNION ALL SELECT 'funnel', 'done', 3 + count_if(metric <> 'include') FROM m""")
def pipeline_manifest(spark, d):
    manifest = run(spark, d, f"{folder_for(spark)}/archive-{uuid.uuid4().hex[:12]}")
    rows = [(e["name"], e["status"], e.get("rows")) for e in manifest.values() if e["name"] != "cleaned"]
    return spark.createDataFrame(rows, "name string, status string, n long")  # a row a stage


@query("""WITH c AS (SELECT c_nationkey AS n, count(*) AS customers, count(DISTINCT c_custkey) AS records, max(c_custkey) AS top FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1)
  SELECT n, CASE n % 5 WHEN 1 THEN 'A' || n WHEN 2 THEN 'C' || n END AS accession, CASE n % 5 WHEN 1 THEN '2.' || customers WHEN 2 THEN '3.' || top END AS sop,
  CASE n % 5 WHEN 0 THEN 'metadata_missing_accession' WHEN 3 THEN 'metadata_empty_or_bad_format' WHEN 4 THEN 'metadata_read_error:ParserError' ELSE 'ok' END AS status, CASE n % 5 WHEN 0 THEN records WHEN 1 THEN 1 ELSE 0 END AS records FROM c""")
def metadata_of_files(spark, d):
    """Customers written as one file of some form a nation, and read again."""
    own, k = read(spark, d, "customer").where("c_nationkey is not null"), F.col("c_nationkey") % 5
    sums = own.groupBy(F.col("c_nationkey").cast("long").alias("n")).agg(F.count("*").alias("customers"), F.max("c_custkey").alias("top"))
    form = F.col("n") % 5
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    first = F.when(form == 0, F.array(F.lit("SOPInstanceUID,AccessionNumber,SeriesDate"))).when(form == 1, F.array(F.lit("Information,Value"), text("Accession Number,A", F.col("n")), text("sop_instance_uid,2.", F.col("customers"))))
    first = first.when(form == 2, F.array(F.lit("k,v"), text("accession,C", F.col("n")), text("SOP instance uid,3.", F.col("top")))).when(form == 3, F.array(F.lit("Information,Value"))).otherwise(F.array(F.lit("a,b"), F.lit("1,2,3")))
    wide = own.where(k == 0).select(F.col("c_nationkey").cast("long").alias("n"), (F.col("c_custkey") + 9).alias("i"), text("1.", F.col("c_custkey"), ",A", F.col("c_custkey"), ",").alias("line"))
    lines = sums.select("n", F.posexplode(first).alias("i", "line")).unionByName(wide)
    top = f"{folder_for(spark)}/metadata-{uuid.uuid4().hex[:12]}"
    lines.repartition("n").sortWithinPartitions("n", "i").select("n", "line").write.partitionBy("n").text(top)
    rows = cut(U.read_each(spark, top, "part-*"))
    number = lambda c: F.regexp_extract(c, "/n=([0-9]+)", 1).cast("long").alias("n")
    records = U.metadata_records(rows).groupBy(number("path")).agg(F.count("*").alias("records"))
    keys = U.metadata_keys(rows).select(number("folder"), "accession", "sop", F.regexp_replace("status", r"\(.*", "").alias("status"))
    return keys.join(records, "n", "left").select("n", "accession", "sop", "status", F.coalesce("records", F.lit(0)).alias("records"))
