"""Queries over the order of whole tables and over node ids; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import order as O
from .catalog import query, read


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem""")
def rows_in_order(spark, d):
    own = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return O.numbered(own, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").drop("l_extendedprice")


@query("""SELECT l_orderkey, l_linenumber, place, items, items / sum(q) OVER () AS share FROM (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q,
  row_number() OVER w AS place, (sum(l_quantity::BIGINT) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS items FROM lineitem WINDOW w AS (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity))""")
def running_quantities(spark, d):
    own = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"))
    return O.running(own, "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q", sums={"items": "q"}).select("l_orderkey", "l_linenumber", "place", "items", (F.col("items") / F.col("items_total")).alias("share"))


_UID = "md5(source || n_chars % 97)"


@query(f"""WITH u AS (SELECT doc_id, {_UID} AS uid FROM documents), g AS (SELECT uid, min(doc_id) AS m FROM u GROUP BY uid), p AS (SELECT uid, row_number() OVER (ORDER BY m, uid) AS group_place FROM g)
  SELECT doc_id, uid, group_place, row_number() OVER (PARTITION BY uid ORDER BY doc_id) AS row_place FROM u JOIN p USING (uid)""")
def groups_as_met(spark, d):
    return O.grouped_rows(read(spark, d, "documents").select("doc_id", F.md5(F.concat("source", (F.col("n_chars") % 97).cast("string"))).alias("uid")), "uid", "doc_id")


_GRAPH = """WITH r AS (SELECT doc_id, trim(source) AS source, CASE WHEN n_chars % 5 = 0 THEN 'N/A' ELSE lang || n_chars % 40 END AS method, nullif(trim(text), '') AS limits,
    CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang || ' of ' || source END AS future FROM documents),
  k AS (SELECT 0 AS k, 'method' AS graph, doc_id, source, nullif(trim(method), 'N/A') AS target, trim(method) AS whole FROM r UNION ALL SELECT 1, 'limits', doc_id, source, substr(limits, 1, 80), limits FROM r
    UNION ALL SELECT 2, 'future', doc_id, source, nullif(substr(trim(future), 1, 80), ''), trim(future) FROM r),
  e AS (SELECT k, graph, source, target, arg_min(whole, doc_id) AS whole, min(doc_id) AS first FROM k WHERE target IS NOT NULL AND source <> '' GROUP BY ALL),
  l AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT DISTINCT source AS name FROM r WHERE source <> '')),
  t AS (SELECT k, target AS name, row_number() OVER (PARTITION BY k ORDER BY target) - 1 + (k + 1) * step AS id FROM (SELECT DISTINCT k, target FROM e),
    (SELECT 10 ^ greatest(4, ceil(log10(max(n)))) AS step FROM (SELECT count(DISTINCT target) AS n FROM e GROUP BY k)))"""
_RIGHT = {"method": "method", "limits": "limits", "future": "future"}


def _graphs(spark, d):
    method = F.when(F.col("n_chars") % 5 == 0, "N/A").otherwise(F.concat("lang", (F.col("n_chars") % 40).cast("string")))
    own = read(spark, d, "documents").select("doc_id", "source", method.alias("method"), F.col("text").alias("limits"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.concat("lang", F.lit(" of "), "source")).alias("future"))
    return O.graphs(own, "doc_id", "source", _RIGHT, {"limits": 80, "future": 80})


@query(f"""{_GRAPH} SELECT graph, 'left' AS kind, source AS name, id, count(*) AS degree, greatest(14, least(36, 12 + 3 * count(*)))::BIGINT AS size FROM e JOIN l ON source = name GROUP BY graph, source, id
  UNION ALL SELECT graph, 'right', target, id::BIGINT, count(*), CASE WHEN graph = 'method' THEN greatest(12, least(34, 10 + 3 * count(*))) ELSE 14 END FROM e JOIN t ON e.k = t.k AND target = name GROUP BY graph, target, id""")
def graph_nodes(spark, d):
    nodes, _ = _graphs(spark, d)
    return nodes.drop("full_text")


@query(f"""{_GRAPH} SELECT graph, l.id AS source_id, t.id::BIGINT AS target_id, sha256(f.whole) AS text_sha256 FROM e JOIN l ON source = l.name JOIN t ON e.k = t.k AND target = t.name
  JOIN (SELECT k, target, arg_min(whole, first) AS whole FROM e GROUP BY ALL) f ON e.k = f.k AND e.target = f.target""")
def graph_edges(spark, d):
    nodes, edges = _graphs(spark, d)
    texts = nodes.where("kind = 'right'").select("graph", F.col("id").alias("target_id"), F.sha2("full_text", 256).alias("text_sha256"))
    return edges.join(texts, ["graph", "target_id"])
