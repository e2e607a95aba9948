"""Queries over cleaned text, JSON documents and records that are matched, merged and paired; they join the catalogue's."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import nested as N
from ..functions import text as T
from ..operators import cohort as H
from ..operators import probes as B
from ..operators import records as R
from ..operators import retrieval
from ..sources import tables
from .catalog import query, read
from .texts import quoted


def _sql_chain(c: str, rules, options: str = "g") -> str:
    """The same replacements in SQL, whose engine writes groups as \\1 and has no look-around."""
    for pattern, by in rules:
        c = f"regexp_replace({c}, {quoted(pattern)}, {quoted(re.sub('[$]([0-9])', lambda m: chr(92) + m[1], by))}, '{options}')"
    return c


_SHORT = "p_name || CASE p_size % 6 WHEN 0 THEN ' LAD 80%, s/p PCI w/ DES' WHEN 1 THEN ' 6 F sheath; hx of HTN' WHEN 2 THEN ' OM2 and D1, LV gram' WHEN 3 THEN ' Seg. 4 HCC, TACE w/o CP' WHEN 4 THEN ' 2 wks f/u, 60 y/o pt' ELSE ' NSTEMI dm2 lvef' END"
_BEYOND = {r"(\d+)\s*F\b(?!\w)": (r"(\d+)\s*F\b", "$1 French (catheter size)"), r"\bw/(?=\s|$)": (r"\bw/(\s|$)", "with$1")}


@query(f"SELECT {_sql_chain(f'({_SHORT})', [_BEYOND.get(p, (p, by)) for p, by in T.ABBREVIATIONS], 'gi')} AS text, count(*) AS n FROM part GROUP BY 1")
def abbreviations_expanded(spark, d):
    return read(spark, d, "part").groupBy(T.expand_abbreviations(F.expr(_SHORT)).alias("text")).agg(F.count("*").alias("n"))


_HEADED = "'findings - ' || lang || chr(10) || 'Impression:' || chr(10) || source || chr(10) || chr(10) || ' Plan' || chr(10) || 'x' || n_chars % 7 || chr(10) || 'Coronary Findings : y'"
_OWN_LINE = [rule for h in T.SECTIONS for rule in ((rf"(?im)^\s*{h}\s*[:\-]?\s*$", f"{h}:"), (rf"(?im)^\s*{h}\s*[:\-]\s*", f"{h}: "))]
_APART = [("(?m)^((?:" + "|".join(T.SECTIONS) + "):)", "\n$1"), ("\n\n\n((?:" + "|".join(T.SECTIONS) + "):)", "\n\n$1"), (r"^\n+", "")]


@query(f"SELECT {_sql_chain(f'({_HEADED})', _OWN_LINE + _APART)} AS text, count(*) AS n FROM documents GROUP BY 1")
def section_headers(spark, d):
    return read(spark, d, "documents").groupBy(T.section_headers(F.expr(_HEADED)).alias("text")).agg(F.count("*").alias("n"))


_FINDINGS = "'FINDINGS: ' || repeat('ab ', (n_chars % 60)::INTEGER) || lang"


@query(f"""WITH t AS (SELECT {_FINDINGS} AS s, 'TECHNIQUE: ' || source || chr(10) || {_FINDINGS} AS w FROM documents WHERE n_chars IS NOT NULL)
  SELECT count(*) AS reports, count_if(length(s) < 100) AS whole, sum(length(CASE WHEN length(s) < 100 THEN w ELSE s END)) AS chars, median(length(w)) AS median_before, median(length(s)) FILTER (length(s) >= 100) AS median_after FROM t""")
def sliced_or_whole(spark, d):
    text = F.concat(F.lit("TECHNIQUE: "), "source", F.lit("\nFINDINGS: "), F.expr("repeat('ab ', int(n_chars % 60))"), "lang")
    own = read(spark, d, "documents").where("n_chars is not null").select(text.alias("w")).select("w", T.sliced_or_whole(F.col("w")).alias("s"))
    cut = F.col("s") != F.col("w")
    return own.agg(F.count("*").alias("reports"), F.count_if(~cut).alias("whole"), F.sum(F.length("s")).alias("chars"), F.median(F.length("w")).alias("median_before"), F.median(F.when(cut, F.length("s"))).alias("median_after"))


@query("SELECT p_name || ' of ' || p_brand AS text, count(*) AS n FROM part GROUP BY 1")
def generated_texts(spark, d):
    lead = F.when(F.col("p_size") % 3 == 0, "Rephrased report :  ").when(F.col("p_size") % 3 == 1, "REPORT:\r\n").otherwise("")
    mark = F.when(F.col("p_size") % 2 == 0, '"').otherwise("'")
    text = F.concat(lead, mark, F.lit(" "), "p_name", F.lit("\t of  "), "p_brand", mark, F.lit(" \n"))
    return read(spark, d, "part").groupBy(T.generated_text(text).alias("text")).agg(F.count("*").alias("n"))


# -- JSON documents, written alike in both engines

_JSON = """'{"id":' || event_id || ',"title":"' || CASE WHEN event_id % 2 = 0 THEN ' Untitled' ELSE event_type END || '","year":' || CASE WHEN event_id % 3 = 0 THEN '1999' ELSE 'null' END
  || ',"parts":[],"flags":{"odd":' || CASE WHEN event_id % 2 = 1 THEN 'true' ELSE 'false' END || ',"in":{"late":true,"x:":"y:"},"list":[true,false]},"kinds":["other","' || CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE event_type END || '",null,null,null,null,null,"other","other",null,null,null,null,null,null,null,"other","other","other","other","other"],"props":' || coalesce(props, 'null') || '}'"""
_LEAVES = f"""WITH d AS (SELECT event_id, ({_JSON})::JSON AS j FROM events WHERE event_id IS NOT NULL), n AS (SELECT event_id, count(*) AS total, count_if(t.type IN ('NULL', 'ARRAY') OR t.atom::VARCHAR IN ('"other"', '"unknown"')) AS empty
  FROM d, json_tree(d.j) AS t WHERE t.type <> 'OBJECT' AND (t.type <> 'ARRAY' OR json_array_length(t.value) = 0) GROUP BY event_id)"""


def _json(spark, d):
    return read(spark, d, "events").where("event_id is not null").select("event_id", "event_type", F.expr(_JSON).alias("j"))


@query(f"{_LEAVES} SELECT event_id, total, empty FROM n")
def json_leaf_counts(spark, d):
    n = N.leaf_counts(F.col("j"))
    return _json(spark, d).select("event_id", n["total"].cast("long").alias("total"), n["empty"].cast("long").alias("empty"))


@query(f"{_LEAVES} SELECT event_id, event_id % 2 = 0 AND event_id % 3 <> 0 AND empty / total >= 0.8 AS hollow FROM n")
def degenerate_records(spark, d):
    return _json(spark, d).select("event_id", N.degenerate(F.col("j")).alias("hollow"))


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND (o_orderstatus = 'F') AS hollow FROM orders""")
def checklist_degenerate_records(spark, d):
    said = F.when(F.col("o_orderstatus") == "F", " no ").otherwise("Yes")
    title, year = F.when(F.col("o_orderkey") % 3 == 0, "untitled").otherwise("A title"), F.when(F.col("o_orderkey") % 2 != 0, 2001)
    items = F.struct(F.struct(F.lit("NO").alias("adherence")).alias("item1"), F.struct(said.alias("adherence")).alias("item2"))
    record = F.to_json(F.struct(title.alias("title"), year.alias("year"), items.alias("adherence")))
    return read(spark, d, "orders").select("o_orderkey", N.checklist_degenerate(record).alias("hollow"))


@query(f"""WITH d AS (SELECT ({_JSON})::JSON AS j FROM events WHERE event_id IS NOT NULL) SELECT replace(substr(t.fullkey, 3), '"', '') AS path, count_if(t.atom::VARCHAR = 'true') AS yes, count(*) AS n
  FROM d, json_tree(d.j) AS t WHERE t.type = 'BOOLEAN' AND NOT contains(t.fullkey, '[') GROUP BY 1""")
def json_boolean_paths(spark, d):
    cells = _json(spark, d).select(F.explode(N.boolean_paths(F.col("j"))).alias("path", "v"))
    return cells.groupBy("path").agg(F.count_if("v").alias("yes"), F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN (props->>'k')::BIGINT END AS k FROM events WHERE event_id IS NOT NULL AND props IS NOT NULL""")
def lenient_json_objects(spark, d):
    own = read(spark, d, "events").where("event_id is not null and props is not null")
    text = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || '```' WHEN 2 THEN 'Sure: ' || props || ' done' ELSE '[' || props || ']' END")
    return own.select("event_id", N.field(N.lenient_object(text), "$.k", "long").alias("k"))


@query("""SELECT p_partkey, concat_ws('|', p_name, p_brand, CASE WHEN p_type <> p_name THEN p_type END, 'a-b') AS options FROM part WHERE p_partkey IS NOT NULL""")
def option_lists(spark, d):
    labels = F.array(F.concat(F.lit(" - "), "p_name"), F.lit("Other (specify)"), F.col("p_name"), F.concat("p_brand", F.lit(" • ")), F.lit(" "), F.col("p_type"), F.lit(None).cast("string"), F.lit("a-b"), F.lit("cut"))
    return read(spark, d, "part").where("p_partkey is not null").select("p_partkey", F.array_join(N.options(labels), "|").alias("options"))


@query("""SELECT CASE event_id % 5 WHEN 0 THEN '$' WHEN 1 THEN '$.items' WHEN 2 THEN '$.aa' END AS path, CASE WHEN event_id % 5 < 3 THEN 2 END AS size, event_id % 5 = 3 AS has_list, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL""")
def json_lists_found(spark, d):
    text = F.expr("""CASE event_id % 5 WHEN 0 THEN '["' || event_type || '","b"]' WHEN 1 THEN '{"aa":["z"],"items":[{"q":1},{"q":"' || event_type || '"}]}' WHEN 2 THEN '{"zz":["b"],"n":[1],"aa":["' || event_type || '","c"]}' WHEN 3 THEN '{"sequences":[],"n":[1,2]}' ELSE event_type END""")
    own = read(spark, d, "events").where("event_type is not null").select(N.found_list(text, ["sequences", "items"]).alias("f"), N.has_list(text).alias("has_list"))
    return own.groupBy("f.path", F.size("f.items").cast("int").alias("size"), "has_list").agg(F.count("*").alias("n")).withColumn("size", F.when(F.col("path").isNotNull(), F.col("size")))


@query("""SELECT l_orderkey::VARCHAR AS uid, count(*) AS questions, count_if(l_returnflag = 'R') AS yes FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey HAVING count_if(l_returnflag IN ('R', 'A')) > 0""")
def questions_of_documents(spark, d):
    answer = F.when(F.col("l_returnflag") == "R", "yes").when(F.col("l_returnflag") == "A", "no").otherwise("unclear")
    qa = F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("question"), answer.alias("answer"))))
    sequences = read(spark, d, "lineitem").where("l_orderkey is not null").groupBy("l_orderkey").agg(qa.alias("qa")).select(F.struct(F.col("l_orderkey").cast("string").alias("sequence_instance_uid"), "qa").alias("s"))
    texts = sequences.select(F.to_json(F.struct(F.array("s").alias("sequences"))).alias("text"))
    rows = tables.question_rows(texts, "text")
    counts = rows.groupBy("uid").agg(F.count("*").alias("questions"))
    return H.keep_yes_no(rows.where("trim(uid) <> ''"), "answer").groupBy("uid").agg(F.count_if(F.col("answer") == "yes").alias("yes")).join(counts, "uid")


# -- records


@query("""WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_partkey AS o, CASE WHEN p_partkey % 4 > 0 THEN 'd' || p_partkey * 7 % 301 END AS a, CASE WHEN p_partkey % 9 > 0 THEN 't ' || p_partkey * p_partkey % 211 END AS b, p_type AS src FROM part),
  s AS (SELECT 0::BIGINT AS i, []::STRUCT(o BIGINT, a VARCHAR, b VARCHAR)[] AS kept, NULL::BIGINT AS o, NULL::BIGINT AS head, NULL::VARCHAR AS src UNION ALL
    SELECT i, CASE WHEN hit IS NULL THEN list_append(kept, {'o': o, 'a': a, 'b': b}) ELSE kept END, o, coalesce(hit, o), src FROM
      (SELECT r.i, s.kept, r.o::BIGINT AS o, r.a, r.b, r.src, coalesce(list_filter(s.kept, lambda x: x.a = r.a)[1].o, list_filter(s.kept, lambda x: x.b = r.b)[1].o) AS hit FROM s JOIN r ON r.i = s.i + 1))
  SELECT head AS p_partkey, string_agg(src, ', ' ORDER BY o) AS merged FROM s WHERE i > 0 GROUP BY head""")
def merged_records(spark, d):
    own = read(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 4 > 0 THEN ' D' || p_partkey * 7 % 301 ELSE ' ' END AS doi", "CASE WHEN p_partkey % 9 > 0 THEN 'T: ' || p_partkey * p_partkey % 211 END AS title", "p_type")
    return R.merge_records(own, "p_partkey", "doi", "title", "p_type").withColumn("p_partkey", F.col("p_partkey").cast("long"))


_TEMPLATES = ["is there a stent", "which vessel holds the catheter", "what is the artery"]


@query(f"""WITH q AS (SELECT p_size % 3 AS t, p_size % 11 AS k FROM part WHERE p_size IS NOT NULL), m AS (SELECT k, list_extract({_TEMPLATES}, (t + 1)::INTEGER) AS m FROM q), s AS (SELECT m, k, 2.0 * length(m) / (2 * length(m) + k) AS score FROM m)
  SELECT m || repeat('~', k::INTEGER) AS question, CASE WHEN score >= 0.85 THEN m END AS match, round(score, 9) AS score, CASE WHEN k = 0 THEN 'exact' WHEN score >= 0.85 THEN 'fuzzy' ELSE 'none' END AS strategy, count(*) AS n FROM s GROUP BY ALL""")
def closest_templates(spark, d):
    question = F.concat(F.get(F.array(*map(F.lit, _TEMPLATES)), F.col("p_size") % 3), F.repeat(F.lit("~"), (F.col("p_size") % 11).cast("int")))
    met = R.match_template(read(spark, d, "part").where("p_size is not null").select(question.alias("question")), "question", _TEMPLATES, 0.85)
    return met.groupBy("question", "match", F.round("score", 9).alias("score"), "strategy").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, min('/m/' || o_orderkey % 10 || '/1.2.' || o_custkey || '_' || o_orderkey || '.png') AS path FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def paths_by_contained_uid(spark, d):
    paths = read(spark, d, "orders").where("o_custkey is not null").selectExpr("'/m/' || o_orderkey % 10 || '/1.2.' || o_custkey || '_' || o_orderkey || '.png' AS path")
    keys = read(spark, d, "customer").selectExpr("c_custkey", "'1.2.' || c_custkey AS uid")
    return R.first_path(keys, "uid", paths, "path").select("c_custkey", "path")


@query("""WITH s AS (SELECT p_brand, l_returnflag AS m, round(avg(l_discount), 3) AS f FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 40 GROUP BY ALL)
  SELECT DISTINCT p.p_brand, a.f AS "A", r.f AS "R" FROM part p LEFT JOIN s a ON a.p_brand = p.p_brand AND a.m = 'A' LEFT JOIN s r ON r.p_brand = p.p_brand AND r.m = 'R'""")
def scores_beside_rows(spark, d):
    part = read(spark, d, "part")
    own = read(spark, d, "lineitem").join(part.where("p_size < 40"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand", "l_returnflag").agg(F.avg("l_discount").alias("f"))
    return R.with_scores(part.select("p_brand").distinct(), "p_brand", own, "l_returnflag", "f", ["A", "R"])


@query("""WITH f AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 3 = 0) SELECT c_custkey, count(*) AS n, string_agg('m' || o_orderkey, ',' ORDER BY 'm' || o_orderkey) AS paths, 'Sequences: ' || count(*) || chr(10) || c_name AS prompt
  FROM customer JOIN f ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) >= 2""")
def study_text_pairs(spark, d):
    orders = read(spark, d, "orders").where("o_orderkey is not null")
    reports = read(spark, d, "customer").join(orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("uids")), "c_custkey").select("c_custkey", "uids", "c_name")
    files = orders.where("o_orderkey % 3 = 0").select(F.explode(F.array("o_orderkey")).alias("uid"), F.concat(F.lit("m"), "o_orderkey").alias("path")).distinct()
    return R.study_pairs(reports, "c_custkey", "uids", "c_name", files, "uid", "path", 2).withColumn("paths", F.array_join("paths", ","))


@query("""WITH p AS (SELECT user_id, event_type, arg_min((value > 50)::INTEGER, event_id) AS p FROM events WHERE value IS NOT NULL GROUP BY ALL), t AS (SELECT user_id, event_type, (max(value) > 120)::INTEGER AS t FROM events GROUP BY ALL),
  c AS (SELECT event_type, count(*) AS n, count_if(p = 1 AND t = 1) AS tp, count_if(p = 0 AND t = 0) AS tn, count_if(p <> t) AS x FROM p JOIN t USING (user_id, event_type) GROUP BY event_type)
  SELECT event_type, n, round((CASE WHEN tp + x > 0 THEN 2.0 * tp / (2 * tp + x) ELSE 0 END + CASE WHEN tn + x > 0 THEN 2.0 * tn / (2 * tn + x) ELSE 0 END) / ((tp + x > 0)::INTEGER + (tn + x > 0)::INTEGER), 3) AS f1 FROM c""")
def readout_scores(spark, d):
    own = read(spark, d, "events")
    truth = own.groupBy("user_id", "event_type").agg((F.max("value") > 120).cast("int").alias("truth"))
    return R.readout_f1(own.withColumn("pred", (F.col("value") > 50).cast("int")), truth, ["user_id", "event_type"], "event_type", "event_id")


@query("""WITH a AS (SELECT doc_id, min(toxic::VARCHAR) AS a FROM labels WHERE doc_id % 3 > 0 GROUP BY 1), b AS (SELECT doc_id, min(quality::VARCHAR) AS b FROM labels WHERE doc_id % 4 > 0 GROUP BY 1), j AS (SELECT doc_id, min('j' || toxic) AS j FROM labels WHERE doc_id % 2 = 0 GROUP BY 1)
  SELECT doc_id, a, b, CASE WHEN a = b THEN a ELSE coalesce(j, '') END AS final, coalesce(a <> b, false) AS disputed FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN j USING (doc_id)""")
def adjudicated_labels(spark, d):
    labels = read(spark, d, "labels")
    said = lambda rule, text: labels.where(rule).selectExpr("doc_id", f"{text} AS label")
    return R.adjudicated(read(spark, d, "documents"), "doc_id", said("doc_id % 3 > 0", "string(toxic)"), said("doc_id % 4 > 0", "string(quality)"), said("doc_id % 2 = 0", "'j' || toxic"))


@query("""WITH f AS (SELECT l_returnflag, l_linenumber, count_if(l_discount < 0.05) AS correct, count_if(l_tax < 0.08) AS evaluated, count_if(l_tax >= 0.08) AS skipped, count(*) AS n FROM lineitem GROUP BY ALL)
  SELECT l_returnflag, sum(correct)::BIGINT AS correct, sum(evaluated)::BIGINT AS evaluated, sum(skipped)::BIGINT AS skipped, round_even(sum(n) / 7, 0)::BIGINT AS n_train, round_even(sum(n + 1) / 7, 0)::BIGINT AS n_test, count_if(evaluated > 0) AS folds, round(avg(correct / evaluated), 9) AS mean_rate FROM f GROUP BY 1""")
def folds_pooled(spark, d):
    own = read(spark, d, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").alias("fold")).agg(
        F.count_if(F.col("l_discount") < 0.05).alias("correct"), F.count_if(F.col("l_tax") < 0.08).alias("evaluated"), F.count_if(F.col("l_tax") >= 0.08).alias("skipped"), F.count("*").alias("n_train"), (F.count("*") + 1).alias("n_test"))
    pooled = R.pooled_folds(own, ["l_returnflag"], 7)
    mean = F.aggregate("fold_rates", F.lit(0.0), lambda s, x: s + x) / F.size("fold_rates")
    return pooled.withColumns({"folds": F.size("fold_rates").cast("long"), "mean_rate": F.round(mean, 9)}).drop("fold_rates")


@query("""WITH c AS (SELECT event_type AS stage, CASE WHEN value < 50 THEN 'low' WHEN value < 100 THEN 'middle' ELSE 'high' END AS metric, count(*) AS sequences, sum(event_id)::BIGINT AS frames FROM events WHERE value IS NOT NULL GROUP BY ALL),
  l AS (SELECT * FROM (VALUES (0, 'click', 'low'), (1, 'click', 'never'), (2, 'view', 'high')) AS l(place, stage, metric))
  SELECT place, stage, metric, sequences, frames FROM l LEFT JOIN c USING (stage, metric) UNION ALL
  SELECT (row_number() OVER (ORDER BY stage, metric) + 2)::INTEGER, stage, metric, sequences, frames FROM c WHERE stage IN ('click', 'view') AND (stage, metric) NOT IN (SELECT (stage, metric) FROM l)""")
def funnel_report(spark, d):
    metric = F.when(F.col("value") < 50, "low").when(F.col("value") < 100, "middle").otherwise("high")
    counts = read(spark, d, "events").where("value is not null").groupBy(F.col("event_type").alias("stage"), metric.alias("metric")).agg(F.count("*").alias("sequences"), F.sum("event_id").alias("frames"))
    return R.funnel_rows(counts, [("click", "low"), ("click", "never"), ("view", "high")])


_DOT = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 9)"


@query(f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, {_DOT} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 20),
  g AS (SELECT query_id, label, max(s) AS similarity, string_agg(vec_id, ',' ORDER BY s DESC, vec_id) AS items FROM n GROUP BY ALL)
  SELECT query_id, label, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, label)::INTEGER AS rank, items FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, label) <= 3""")
def groups_by_similarity(spark, d):
    items = read(spark, d, "embeddings")
    near = retrieval.nearest(items.where("vec_id % 50 = 0"), items, 20).join(items.select("vec_id", "label"), "vec_id")
    got = R.nested_ranks(near, "label", "vec_id", 3)
    return got.select("query_id", "label", F.round("similarity", 6).alias("similarity"), "rank", F.array_join(F.transform("items", lambda x: x["id"].cast("string")), ",").alias("items"))


@query("""WITH b AS (SELECT event_type, min(value) AS lo, max(value) AS hi, min(user_id) AS ul, max(user_id) AS uh, count(*) AS n FROM events WHERE value >= 20 GROUP BY 1),
  s AS (SELECT event_id, event_type, n, CASE WHEN value >= 20 THEN round(0.7 * CASE WHEN hi = lo THEN 0 ELSE (value - lo) / (hi - lo) END + 0.3 * CASE WHEN uh = ul THEN 0 ELSE (user_id - ul) / (uh - ul) END, 9) END AS score FROM events LEFT JOIN b USING (event_type))
  SELECT event_id, score, CASE WHEN score IS NOT NULL AND row_number() OVER (PARTITION BY event_type ORDER BY score DESC NULLS LAST, event_id) <= greatest(1, round_even(n * 15.0 / 100, 0)) THEN 'informative' ELSE 'uninformative' END AS label FROM s""")
def informative_rows(spark, d):
    got = R.informative(read(spark, d, "events"), "event_type", "event_id", {"value": 0.7, "user_id": 0.3}, F.col("value") < 20, 15)
    return got.select("event_id", "score", "label")


@query("""WITH w AS (SELECT doc_id, lower(regexp_replace(unnest(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+')), '^[.,!?;:()\\[\\]{}"'']+|[.,!?;:()\\[\\]{}"'']+$', '', 'g')) AS w FROM documents), c AS (SELECT doc_id, ('0x' || left(md5(w), 8))::BIGINT % 64 AS bucket, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL)
  SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 9) AS weight FROM c""")
def hashed_word_vectors(spark, d):
    return R.hashed_words(read(spark, d, "documents"), "doc_id", "text", 64).select("doc_id", "bucket", F.round("weight", 9).alias("weight"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT label, embedding::DOUBLE[] AS v, list_dot_product(embedding::DOUBLE[], q) / 0.1 AS s FROM embeddings, q), w AS (SELECT label, v, exp(s - max(s) OVER (PARTITION BY label)) AS w FROM s),
  c AS (SELECT label, (i - 1)::INTEGER AS "at", sum(w * v[i]) AS y FROM w, range(1, 65) AS r(i) GROUP BY ALL) SELECT label, "at", round(y / sqrt(sum(y * y) OVER (PARTITION BY label)), 6) AS value FROM c""")
def attention_pooled(spark, d):
    items = read(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    one = items.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return R.attention_pool(items.join(F.broadcast(one)), "label", "embedding", F.col("q")).select("label", "at", F.round("value", 6).alias("value"))


@query("""SELECT p_partkey, left(sha1('{"brand":' || coalesce('"' || p_brand || '"', 'null') || ',"size":"' || p_size || '","steps":"20"}'), 8) AS hash FROM part WHERE p_size IS NOT NULL""")
def config_hashes(spark, d):
    return read(spark, d, "part").where("p_size is not null").select("p_partkey", N.config_hash(("steps", F.lit(20)), ("size", F.col("p_size")), ("brand", F.col("p_brand"))).alias("hash"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS f, l_quantity::INTEGER % 9 - 1 AS n, l_suppkey % 4 AS m FROM lineitem), i AS (SELECT *, n >= 0 AND n < f AS wrong FROM r)
  SELECT m <> 0 AS has_best, CASE WHEN wrong THEN -1 ELSE f END::INTEGER AS first, CASE WHEN wrong THEN -1 ELSE n END::INTEGER AS last, NOT wrong AND n >= 0 AS kept, count(*) AS n FROM i GROUP BY ALL""")
def frame_windows(spark, d):
    best = F.when(F.col("l_suppkey") % 4 == 0, "none").otherwise((F.col("l_suppkey") % 4).cast("string"))
    w = H.frame_window(best, F.concat(F.lit(" "), F.col("l_linenumber").cast("string")), (F.col("l_quantity").cast("int") % 9).cast("string"), "fl")
    own = read(spark, d, "lineitem").select(w.alias("w")).select((F.col("w.best") >= 0).alias("has_best"), F.col("w.first").cast("int").alias("first"), F.col("w.last").cast("int").alias("last"), "w.kept")
    return own.groupBy("has_best", "first", "last", "kept").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT ('0x' || left(md5('0|' || user_id), 8))::BIGINT % 3 AS fold, (value > 50)::INTEGER AS y FROM events WHERE abs(value - 50) > 10 AND user_id IS NOT NULL)
  SELECT fold::INTEGER AS fold, count(*) AS n, count(*) AS correct, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS balanced FROM e GROUP BY fold""")
def probe_of_separable_rows(spark, d):
    own = read(spark, d, "events").where("abs(value - 50) > 10").select("user_id", F.array(F.col("value"), F.col("value") * 0).alias("x"), (F.col("value") > 50).cast("int").alias("y"))
    return B.probe_report(B.out_of_fold(own, "x", "y", "user_id", 3, reg=0.0), "y", ["fold"])
