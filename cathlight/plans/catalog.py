"""The library's own queries, each with its SQL twin.

The driver tables stand in for the archive: lineitem for instances, orders for studies, customer for
patients, documents for reports, embeddings for frames, labels for reference answers, events for logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as T
from ..functions import values as D
from ..functions import vectors as V
from ..operators import curate as C
from ..operators import evaluate as E
from ..operators import order as O
from ..operators import quantiles as S
from ..operators import retrieval as R
from ..operators import review as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dealt(spark: SparkSession, d: str, values: str, columns: str, n: int) -> DataFrame:
    """Each event with one of n given rows, by its id."""
    listed = spark.sql(f"SELECT * FROM VALUES {values} AS v({columns})")
    return read(spark, d, "events").select((F.col("event_id") % n + 1).cast("int").alias("i")).join(F.broadcast(listed), "i")  # n rows


def dealt_sql(sql: str, n: int) -> str:
    return f"SELECT q.*, n FROM ({sql}) q JOIN (SELECT (event_id % {n} + 1)::INTEGER AS i, count(*) AS n FROM events GROUP BY 1) USING (i)"


# -- archive statistics and cohort queries


@query("""SELECT count(*) AS instances, count(DISTINCT l_orderkey) AS studies, (SELECT count(DISTINCT o_custkey) FROM orders) AS patients,
  count_if(l_returnflag = 'R') AS errors FROM lineitem""")
def archive_stats(spark, d):
    patients = read(spark, d, "orders").agg(F.count_distinct("o_custkey").alias("patients"))
    own = read(spark, d, "lineitem").agg(F.count("*").alias("instances"), F.count_distinct("l_orderkey").alias("studies"), F.count_if(F.col("l_returnflag") == "R").alias("errors"))
    return own.join(F.broadcast(patients))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5")
def modality_top5(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(5)


@query("SELECT count(DISTINCT d.doc_id) AS linked FROM documents d JOIN labels l USING (doc_id)")
def report_linked(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").agg(F.count_distinct("doc_id").alias("linked"))


@query("SELECT lang, count(DISTINCT d.doc_id) AS unlinked FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL GROUP BY lang")
def report_unlinked(spark, d):
    return read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("lang").agg(F.count_distinct("doc_id").alias("unlinked"))


@query("""SELECT o_orderkey, max(o_orderstatus) AS status, substr(max(o_orderpriority), 1, 3) AS priority, max(l_shipmax) AS last_ship, max(n) AS n
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS l_shipmax, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def enrich_by_key(spark, d):
    items = read(spark, d, "lineitem").where("l_quantity > 45").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"), F.count("*").alias("n"))
    studies = read(spark, d, "orders").groupBy("o_orderkey").agg(F.max("o_orderstatus").alias("status"), F.substring(F.max("o_orderpriority"), 1, 3).alias("priority"))
    return studies.join(items, studies["o_orderkey"] == items["l_orderkey"], "left").drop("l_orderkey")


@query("SELECT lang, count(*) AS n, avg(n_chars) AS mean_chars, avg(quality) AS mean_quality FROM documents JOIN labels USING (doc_id) WHERE lower(text) LIKE '%tion%' GROUP BY lang")
def report_search_multi_hop(spark, d):
    found = read(spark, d, "documents").where(F.lower("text").like("%tion%")).select("doc_id", "lang", "n_chars")
    return found.join(read(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars"), F.avg("quality").alias("mean_quality"))


@query("SELECT substr(o_orderdate::VARCHAR, 1, 4) AS year, count(DISTINCT o_custkey) AS patients, count(*) AS studies FROM orders GROUP BY 1")
def year_counts(spark, d):
    return read(spark, d, "orders").groupBy(D.year_of(F.col("o_orderdate")).alias("year")).agg(F.count_distinct("o_custkey").alias("patients"), F.count("*").alias("studies"))


@query("SELECT event_type, avg(value) AS mean_value, count(*) AS n FROM events WHERE try_cast(props->>'$.k' AS DOUBLE) > 10 GROUP BY event_type")
def mean_by_key_typed(spark, d):
    typed = D.number(F.get_json_object("props", "$.k"))
    return read(spark, d, "events").where(typed > 10).groupBy("event_type").agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))


@query("SELECT substr(o_orderdate::VARCHAR, 1, 7) AS month, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1 ORDER BY n DESC, month LIMIT 1")
def peak_group(spark, d):
    months = read(spark, d, "orders").where("o_totalprice > 200000").groupBy(F.substring(F.col("o_orderdate").cast("string"), 1, 7).alias("month")).agg(F.count("*").alias("n"))
    return months.orderBy(F.desc("n"), "month").limit(1)


@query("""SELECT reason, count(*) AS n, sum(l_quantity) AS frames FROM (SELECT l_quantity, CASE WHEN l_returnflag = 'R' THEN 'bad_radiation' WHEN l_linestatus = 'F' THEN 'bad_series'
  WHEN l_discount > 0.08 THEN 'bad_motion' WHEN l_quantity <= 5 THEN 'too_few_frames' ELSE 'ok' END AS reason FROM lineitem) GROUP BY ROLLUP (reason)""")
def filter_reason_funnel(spark, d):
    reason = A.ladder(F.lit("ok"), *[(F.expr(c), F.lit(r)) for c, r in (("l_returnflag = 'R'", "bad_radiation"), ("l_linestatus = 'F'", "bad_series"), ("l_discount > 0.08", "bad_motion"), ("l_quantity <= 5", "too_few_frames"))])
    return read(spark, d, "lineitem").select("l_quantity", reason.alias("reason")).rollup("reason").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("frames"))


@query("""SELECT doc_id, copy_index, total_copies FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS copy_index,
  count(*) OVER (PARTITION BY md5(text)) AS total_copies FROM documents) WHERE total_copies > 1""")
def duplicate_copies(spark, d):
    return C.copies(read(spark, d, "documents").select("doc_id", F.md5("text").alias("m")), F.col("m"), "doc_id").select("doc_id", F.col("copy_index").cast("long").alias("copy_index"), "total_copies")


@query("""SELECT o_custkey, count(*) AS studies, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1""")
def multi_parent_keys(spark, d):
    got = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("studies"), F.sort_array(F.collect_set("o_orderstatus")).alias("s"))
    return got.where(F.size("s") > 1).select("o_custkey", "studies", F.array_join("s", ",").alias("statuses"))


@query("""SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_shipdate, l_partkey, l_linenumber) AS series, count(*) AS n, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1""")
def study_rollup_list(spark, d):
    own = F.sort_array(F.collect_list(F.struct("l_shipdate", "l_partkey", "l_linenumber")))
    got = read(spark, d, "lineitem").groupBy("l_orderkey").agg(own.alias("s"), F.count("*").alias("n"), F.min("l_shipdate").alias("first_ship"))
    return got.select("l_orderkey", F.array_join(F.transform("s", lambda x: x["l_linenumber"].cast("string")), ",").alias("series"), "n", "first_ship")


# -- overlaps, duplicates and resumable state


@query("""WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
  SELECT (SELECT count(*) FROM a JOIN b USING (k)) AS in_both, (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS only_left, (SELECT count(*) FROM b ANTI JOIN a USING (k)) AS only_right,
  round(100.0 * (SELECT count(*) FROM a JOIN b USING (k)) / (SELECT count(*) FROM a), 1)::DOUBLE AS coverage""")
def accession_overlap(spark, d):
    left = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    right = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    return C.overlap(left, right, "k").withColumn("coverage", F.col("coverage").cast("double"))


@query("""WITH t AS (SELECT DISTINCT lang, unnest(string_split(text, ' ')) AS w FROM documents WHERE lang IN ('es', 'fr'))
  SELECT count_if(n = 1 AND l = 'es') AS only_es, count_if(n = 1 AND l = 'fr') AS only_fr, count_if(n = 2) AS shared FROM (SELECT w, count(*) AS n, min(lang) AS l FROM t WHERE w <> '' GROUP BY w)""")
def token_symmetric_difference(spark, d):
    words = read(spark, d, "documents").where(F.col("lang").isin("es", "fr")).select("lang", F.explode(F.split("text", " ")).alias("w")).where("w <> ''")
    sides = words.groupBy("w").agg(F.min("lang").alias("l"), F.max("lang").alias("m"))
    return sides.agg(F.count_if((F.col("l") == F.col("m")) & (F.col("l") == "es")).alias("only_es"), F.count_if((F.col("l") == F.col("m")) & (F.col("l") == "fr")).alias("only_fr"), F.count_if(F.col("l") != F.col("m")).alias("shared"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def keep_first(spark, d):
    return C.first_by(read(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], F.asc("event_id"))


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC NULLS LAST, event_id) AS rn FROM events) WHERE rn = 1""")
def keep_latest(spark, d):
    return C.first_by(read(spark, d, "events").select("user_id", "event_id", "value", "ts"), ["user_id"], F.desc("ts"), F.desc_nulls_last("value"), F.asc("event_id")).drop("ts")


@query("SELECT quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality")
def label_value_counts_null(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left").groupBy("quality").agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type""")
def resume_upsert(spark, d):
    events = read(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    cut = F.col("event_id") < 5000
    keys = ["user_id", "event_type"]
    target = C.first_by(events.where(cut), keys, F.desc("event_id"))
    return C.upsert(target, events.where(~cut), keys, F.desc("event_id"))


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def resume_left_anti(spark, d):
    events = read(spark, d, "events").select("user_id", "event_id")
    target = C.first_by(events.where("event_id < 5000"), ["user_id"], F.asc("event_id"))
    return C.append_new(target, events.where("event_id >= 5000"), ["user_id"], F.asc("event_id"))


@query("""SELECT source AS name, 'left' AS side, count(DISTINCT lang) AS degree, least(60, 12 + 3 * count(DISTINCT lang)) AS size FROM documents GROUP BY source
  UNION ALL SELECT lang, 'right', count(DISTINCT source), least(60, 12 + 3 * count(DISTINCT source)) FROM documents GROUP BY lang""")
def graph_degree(spark, d):
    return C.bipartite(read(spark, d, "documents").select("source", "lang"), "source", "lang")[1]


# -- text

_TIDY = "lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')))"
_ANSWERS = "(VALUES (1, NULL), (2, 'Yes'), (3, ' positive '), (4, 'Not visible'), (5, 'maybe'), (6, 'not present'), (7, 'Yes.'), (8, 'Unclear, cannot determine'), (9, 'no, but yes'), (10, '1.0'), (11, '2'), (12, 'stenosis'), (13, 'No - x'), (14, 'n'))"


@query(dealt_sql(f"""WITH a AS (SELECT i, raw, {_TIDY.format(c="raw")} AS t FROM {_ANSWERS} v(i, raw))
  SELECT i, t AS tidy, CASE WHEN {A.clause_of("t", A.TRUE_TERMS)} THEN 'YES' WHEN {A.clause_of("t", A.UNSURE + A.FALSE_TERMS)} THEN 'NO' WHEN contains(t, 'yes') OR contains(t, 'present') OR contains(t, 'positive') THEN 'YES' ELSE 'NO' END AS truth,
  CASE WHEN t IN ('yes', 'y') THEN 'YES' WHEN {A.clause_of("t", A.UNSURE + ["n"])} THEN 'NO' WHEN contains(t, 'yes') THEN 'YES' ELSE 'NO' END AS model,
  CASE WHEN {A.clause_of("t", A.BINARY_TERMS)} OR coalesce(try_cast(t AS DOUBLE) = 1, false) THEN 1 ELSE 0 END AS bin,
  CASE WHEN regexp_extract(t, '^([a-z0-9]+)', 1) IN ('yes', 'y', 'true', '1') THEN 'yes' WHEN regexp_extract(t, '^([a-z0-9]+)', 1) IN ('no', 'n', 'false', '0') THEN 'no' END AS token FROM a""", 14))
def answer_normalise(spark, d):
    raw = F.col("raw")
    told = dealt(spark, d, _ANSWERS[8:-1], "i, raw", 14).select("i", A.tidy(raw).alias("tidy"), A.truth_answer(raw).alias("truth"), A.model_answer(raw).alias("model"), A.binary(raw).alias("bin"), A.first_token(raw).alias("token"))
    return told.groupBy("i", "tidy", "truth", "model", "bin", "token").agg(F.count("*").alias("n"))


@query("""SELECT role, count(*) AS n, sum(length(trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g')))) AS chars FROM conversations GROUP BY role""")
def text_collapse(spark, d):
    return read(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length(T.collapse(F.col("text")))).alias("chars"))


@query("""SELECT lang, count_if(m <> text) AS masked, sum(length(m)) AS chars FROM (SELECT lang, text, regexp_replace(regexp_replace(text, '\\b[\\w.+-]+@[\\w-]+\\.[\\w.]+\\b', '[EMAIL]', 'g'), '\\bhttps?://\\S+', '[URL]', 'g') AS m FROM documents) GROUP BY lang""")
def personal_data_mask(spark, d):
    masked = T.chain(F.col("text"), *T.PERSONAL[:2])
    return read(spark, d, "documents").select("lang", "text", masked.alias("m")).groupBy("lang").agg(F.count_if(F.col("m") != F.col("text")).alias("masked"), F.sum(F.length("m")).alias("chars"))


def _masked_sql(c: str) -> str:
    for pattern, by in T.PERSONAL:
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return c


@query(f"""SELECT lang, count_if(m <> text) AS masked, sum(length(m)) AS chars FROM (SELECT lang, text, {_masked_sql("text")} AS m FROM documents) GROUP BY lang""")
def personal_data_mask_all(spark, d):
    masked = T.mask_personal(F.col("text"))
    return read(spark, d, "documents").select("lang", "text", masked.alias("m")).groupBy("lang").agg(F.count_if(F.col("m") != F.col("text")).alias("masked"), F.sum(F.length("m")).alias("chars"))


# -- evaluation

_PRED = """(SELECT doc_id, lang, toxic, m, p FROM (SELECT d.doc_id, lang, toxic, unnest([{'m': 'even', 'p': (n_chars % 2)::INTEGER}, {'m': 'long', 'p': (n_chars > 1500)::INTEGER},
  {'m': 'marks', 'p': contains(text, '##')::INTEGER}], recursive := true) FROM documents d JOIN labels USING (doc_id)))"""
_SCORES = """tp, tn, fp, fn, (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 AS f1_macro,
  (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * (tp + fn) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) * (tn + fp)) / (tp + tn + fp + fn) AS f1_weighted"""
_COUNTS = "count_if(p = 1 AND toxic = 1) AS tp, count_if(p = 0 AND toxic = 0) AS tn, count_if(p = 1 AND toxic = 0) AS fp, count_if(p = 0 AND toxic = 1) AS fn"


def predictions(spark, d) -> DataFrame:
    """Three rule models' answers on labelled documents, long."""
    rules = [("even", (F.col("n_chars") % 2).cast("int")), ("long", (F.col("n_chars") > 1500).cast("int")), ("marks", F.contains("text", F.lit("##")).cast("int"))]
    docs = read(spark, d, "documents").select("doc_id", "lang", F.inline(F.array(*[F.struct(F.lit(m).alias("m"), p.alias("p")) for m, p in rules])))
    return docs.join(read(spark, d, "labels").select("doc_id", "toxic"), "doc_id")


@query(f"SELECT m, {_SCORES} FROM (SELECT m, {_COUNTS} FROM {_PRED} GROUP BY m)")
def confusion_by_model(spark, d):
    return E.with_scores(E.confusion(predictions(spark, d), ["m"], "toxic", "p")).select("m", "tp", "tn", "fp", "fn", "accuracy", "precision", "recall", "f1", "f1_macro", "f1_weighted")


@query(f"SELECT m, lang, {_SCORES} FROM (SELECT m, lang, {_COUNTS} FROM {_PRED} GROUP BY m, lang)")
def macro_weighted_f1(spark, d):
    return E.with_scores(E.confusion(predictions(spark, d), ["m", "lang"], "toxic", "p")).select("m", "lang", "tp", "tn", "fp", "fn", "accuracy", "precision", "recall", "f1", "f1_macro", "f1_weighted")


@query(f"""SELECT control, {_SCORES} FROM (SELECT control, {_COUNTS} FROM (SELECT toxic, unnest([{{'control': 'original', 'p': p}}, {{'control': 'flipped', 'p': 1 - p}}, {{'control': 'all_yes', 'p': 1}}, {{'control': 'all_no', 'p': 0}}], recursive := true)
  FROM {_PRED} WHERE m = 'long') GROUP BY control)""")
def flipped_controls(spark, d):
    long = E.controls(predictions(spark, d).where("m = 'long'"), "p", "doc_id").where("control <> 'random'")
    return E.with_scores(E.confusion(long, ["control"], "toxic", "answer")).select("control", "tp", "tn", "fp", "fn", "accuracy", "precision", "recall", "f1", "f1_macro", "f1_weighted")


@query(f"SELECT lang, toxic, grouping(lang, toxic) AS level, count(*) AS n, avg(p) AS yes_share FROM {_PRED} WHERE m = 'long' GROUP BY GROUPING SETS ((lang, toxic), (lang), ())")
def group_and_total(spark, d):
    own = predictions(spark, d).where("m = 'long'")
    sets = own.groupingSets([["lang", "toxic"], ["lang"], []], "lang", "toxic")
    return sets.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg("p").alias("yes_share"))


@query(f"""WITH w AS (SELECT doc_id, any_value(toxic) AS t, max(p) FILTER (m = 'long') AS x, max(p) FILTER (m = 'marks') AS y FROM {_PRED} GROUP BY doc_id),
  c AS (SELECT count_if(x = t AND y = t) AS both_right, count_if(x = t AND y <> t) AS b, count_if(x <> t AND y = t) AS c, count_if(x <> t AND y <> t) AS both_wrong FROM w)
  SELECT *, CASE WHEN b + c > 0 THEN (abs(b - c) - 1.0) ^ 2 / (b + c) ELSE 0 END AS chi_square FROM c""")
def paired_counts(spark, d):
    p = predictions(spark, d)
    wide = p.groupBy("doc_id").agg(F.any_value("toxic").alias("t"), F.max(F.when(F.col("m") == "long", F.col("p"))).alias("x"), F.max(F.when(F.col("m") == "marks", F.col("p"))).alias("y"))
    return E.paired(wide, "t", "x", "y").drop("p")


@query(f"""WITH w AS (SELECT doc_id, max(p) FILTER (m = 'long') AS x, max(p) FILTER (m = 'even') AS y FROM {_PRED} GROUP BY doc_id),
  s AS (SELECT count(*) AS n, avg((x = y)::INTEGER) AS po, avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)) AS pe FROM w) SELECT n, po, pe, CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END AS kappa FROM s""")
def kappa(spark, d):
    p = predictions(spark, d)
    wide = p.groupBy("doc_id").agg(F.max(F.when(F.col("m") == "long", F.col("p"))).alias("x"), F.max(F.when(F.col("m") == "even", F.col("p"))).alias("y"))
    return E.kappa(wide, "x", "y")


@query("""SELECT lang, k, n, k / n AS p, greatest(0, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)) AS low,
  least(1, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)) AS high
  FROM (SELECT lang, sum(toxic)::BIGINT AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang)""")
def wilson_by_group(spark, d):
    got = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.sum("toxic").alias("k"), F.count("*").alias("n"))
    low, high = E.wilson(F.col("k"), F.col("n"))
    return got.withColumns({"p": E.ratio(F.col("k"), F.col("n")), "low": low, "high": high})


@query("SELECT lang, n, least(n, round_even(384.16 / (1 + 383.16 / n), 0)::BIGINT) AS size FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def sample_size(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("size", E.cochran(F.col("n")))


@query("""SELECT count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, var_samp(value) AS variance, min(value) AS lowest, max(value) AS highest, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, skewness(value) AS skew, kurtosis(value) AS kurtosis FROM events""")
def describe_distribution(spark, d):
    return E.describe(read(spark, d, "events"), "value")


@query("""WITH z AS (SELECT event_type, CASE WHEN s = 0 THEN 0 ELSE (value - m) / s END AS z FROM (SELECT event_type, value, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY event_type)))
  SELECT event_type, round(min(z), 6) AS low, round(max(z), 6) AS high, count(*) AS n FROM z GROUP BY event_type""")
def zscore_group(spark, d):
    own = read(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    z = F.when(F.col("s") == 0, 0.0).otherwise((F.col("value") - F.col("m")) / F.col("s"))
    scored = read(spark, d, "events").select("event_type", "value").join(own, "event_type")
    return scored.groupBy("event_type").agg(F.round(F.min(z), 6).alias("low"), F.round(F.max(z), 6).alias("high"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT source, count(*) AS c FROM documents GROUP BY source), t AS (SELECT c, row_number() OVER (ORDER BY c DESC, source) AS r FROM c)
  SELECT sum(c)::BIGINT AS total, count(*) AS distinct_values, max(c) / sum(c) AS top1, sum(c) FILTER (r <= 3) / sum(c) AS top3, sum(c * c) / (sum(c) * sum(c)) AS hhi, count_if(c = 1) AS singletons, count_if(c = 1) / count(*) AS singleton_ratio FROM t""")
def venue_concentration(spark, d):
    return E.concentration(read(spark, d, "documents"), "source")


@query("""WITH c AS (SELECT source, count(*) AS c FROM documents GROUP BY source)
  SELECT source, c, (row_number() OVER (ORDER BY c DESC, source))::INTEGER AS place, sum(c) OVER (ORDER BY c DESC, source ROWS UNBOUNDED PRECEDING) / sum(c) OVER () AS share FROM c""")
def venue_cumulative(spark, d):
    return O.cumulative_share(read(spark, d, "documents"), "source").withColumn("place", F.col("place").cast("int"))


@query("SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS types, count(*) AS n FROM part GROUP BY p_brand")
def set_collect(spark, d):
    return read(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_type")), ", ").alias("types"), F.count("*").alias("n"))


_CRITERIA = "'{\"met\":[\"I' || doc_id % 3 || '\",\"I' || n_chars % 4 || '\"],\"failed\":[' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '\"E' || n_chars % 2 || '\"' END || ']}'"


@query(f"""WITH j AS (SELECT from_json({_CRITERIA}, '{{"met":["VARCHAR"],"failed":["VARCHAR"]}}') AS r FROM documents), c AS (SELECT unnest(r.met) AS c, 1 AS met, 0 AS failed FROM j UNION ALL SELECT unnest(r.failed), 0, 1 FROM j)
  SELECT c, sum(met)::BIGINT AS met, sum(failed)::BIGINT AS failed FROM c GROUP BY c""")
def checklist_array_counts(spark, d):
    rows = read(spark, d, "documents").select(F.from_json(F.expr(_CRITERIA), "met array<string>, failed array<string>").alias("r"))
    marks = rows.select(F.explode(F.concat(F.transform("r.met", lambda c: F.struct(c.alias("c"), F.lit(1).alias("m"))), F.transform("r.failed", lambda c: F.struct(c.alias("c"), F.lit(0).alias("m"))))).alias("x"))
    return marks.groupBy(F.col("x.c").alias("c")).agg(F.sum("x.m").alias("met"), F.sum(1 - F.col("x.m")).alias("failed"))


# -- vectors

_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)"


@query(f"""SELECT query_id, rank::INTEGER AS rank, vec_id, round(similarity, 6) AS similarity FROM (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 5""")
def knn_top5(spark, d):
    items = read(spark, d, "embeddings").select("vec_id", "embedding")
    return R.nearest(items.where("vec_id % 20 = 0"), items, 5).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH n AS (SELECT a.vec_id AS q, a.vec_id % 5 AS fold, a.label AS truth, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id % 5 <> b.vec_id % 5),
  v AS (SELECT q, fold, truth, label, k, row_number() OVER (PARTITION BY q, k ORDER BY count(*) DESC, min(r)) AS place FROM n JOIN (VALUES (1), (3), (5)) t(k) ON r <= k GROUP BY q, fold, truth, label, k)
  SELECT k, fold, count(*) AS n, sum((label = truth)::INTEGER)::BIGINT AS hits FROM v WHERE place = 1 GROUP BY k, fold""")
def knn_vote_cv(spark, d):
    """Five folds by id: each item's label is voted by its 1, 3 and 5 nearest items of the other folds."""
    items = read(spark, d, "embeddings").withColumn("fold", F.col("vec_id") % 5)
    truth = items.select(F.col("vec_id").alias("query_id"), F.col("label").alias("truth"), F.col("fold").alias("qf"))
    near = R.nearest(items, items, 5, apart="fold").join(items.select("vec_id", "label"), "vec_id").join(truth, "query_id")
    sized = near.withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5)))).where("rank <= k")
    votes = sized.groupBy("query_id", "truth", "qf", "k", "label").agg(F.count("*").alias("n"), F.min("rank").alias("r"))
    won = votes.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "k").orderBy(F.desc("n"), "r"))).where("place = 1")
    return won.groupBy("k", F.col("qf").alias("fold")).agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("truth")).cast("int")).alias("hits"))


@query("""WITH c AS (SELECT label, i, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i)
  SELECT label, round(max(m) / sqrt(sum(m * m + s * s)), 6) AS top_mean, round(max(s) / sqrt(sum(m * m + s * s)), 6) AS top_sd, (2 * count(*))::INTEGER AS dims FROM c GROUP BY label""")
def temporal_descriptor(spark, d):
    own = R.descriptor(read(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e")), "label", "e")
    half = F.size("descriptor") / 2
    return own.select("label", F.round(F.array_max(F.slice("descriptor", F.lit(1), half.cast("int"))), 6).alias("top_mean"), F.round(F.array_max(F.slice("descriptor", half.cast("int") + 1, half.cast("int"))), 6).alias("top_sd"), F.size("descriptor").alias("dims"))


@query("""WITH s AS (SELECT list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS m, label FROM embeddings)
  SELECT label, count_if(m - med > 0) AS yes, count(*) AS n FROM (SELECT *, median(m) OVER (PARTITION BY label) AS med FROM s) GROUP BY label""")
def margin_debias(spark, d):
    margins = read(spark, d, "embeddings").select("label", V.total(F.col("embedding").cast("array<double>")).alias("m"))
    middle = S.wide_quantiles(margins, "m", {"med": 0.5}, ["label"])
    return margins.join(middle, "label").groupBy("label").agg(F.count_if(F.col("m") - F.col("med") > 0).alias("yes"), F.count("*").alias("n"))


@query("""WITH t AS (SELECT DISTINCT lang, unnest(string_split(lower(text), ' ')) AS w FROM documents), n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
  p AS (SELECT a.lang AS a, b.lang AS b, count(*) AS both_ FROM t a JOIN t b USING (w) WHERE a.lang < b.lang GROUP BY 1, 2)
  SELECT a, b, 1 - both_ / (x.n + y.n - both_) AS distance FROM p JOIN n x ON x.lang = a JOIN n y ON y.lang = b""")
def jaccard_matrix(spark, d):
    words = read(spark, d, "documents").select("lang", F.explode(F.split(F.lower("text"), " ")).alias("w")).groupBy("w").agg(F.sort_array(F.collect_set("lang")).alias("langs"))  # a handful of languages
    sizes = words.select(F.explode("langs").alias("lang")).groupBy("lang").agg(F.count("*").alias("n"))
    both = words.select(F.explode("langs").alias("a"), "langs").select("a", F.explode("langs").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    return both.join(sizes.select(F.col("lang").alias("a"), F.col("n").alias("x")), "a").join(sizes.select(F.col("lang").alias("b"), F.col("n").alias("y")), "b").select("a", "b", (1 - F.col("both") / (F.col("x") + F.col("y") - F.col("both"))).alias("distance"))


# -- series

@query("""SELECT substr(ts::VARCHAR, 1, 10) AS day, sum(value * (event_id % 7 + 1)) / sum(event_id % 7 + 1) AS mean, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1""")
def weighted_epoch_mean(spark, d):
    w = F.col("event_id") % 7 + 1
    return read(spark, d, "events").groupBy(F.substring(F.col("ts").cast("string"), 1, 10).alias("day")).agg((F.sum(F.col("value") * w) / F.sum(w)).alias("mean"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))


@query("""SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda a, x: a * 0.98 + x * 0.02), 6) AS ema FROM events GROUP BY user_id""")
def ema_fold(spark, d):
    return E.ema(read(spark, d, "events"), "user_id", "event_id", "value").withColumn("ema", F.round("ema", 6))


@query("""SELECT conv_id, n, CASE WHEN n <= 3 THEN range(n) ELSE list_distinct([0, round_even((n - 1) / 2.0, 0)::BIGINT, n - 1]).list_sort() END AS picked FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)""")
def uniform_subsample(spark, d):
    sized = read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return sized.select("conv_id", "n", D.uniform_indices(F.col("n"), 3).cast("array<bigint>").alias("picked"))


@query("""WITH m AS (SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 MONTH)) AS t)
  SELECT strftime(t, '%Y-%m') AS month, coalesce(n, 0) AS n FROM m LEFT JOIN (SELECT date_trunc('month', o_orderdate) AS o, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1) ON o = t""")
def calendar_zero_fill(spark, d):
    orders = read(spark, d, "orders")
    months = orders.agg(F.trunc(F.min("o_orderdate"), "month").alias("a"), F.trunc(F.max("o_orderdate"), "month").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("t"))
    counts = orders.where("o_totalprice > 400000").groupBy(F.trunc("o_orderdate", "month").alias("o")).agg(F.count("*").alias("n"))
    return months.join(counts, F.col("o") == F.col("t"), "left").select(F.date_format("t", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


_DATES = "(1, '20240231', '09'), (2, '20241301', '0930'), (3, '2024-03-05', '093015.5'), (4, 'x', '09:30:15'), (5, '20240305', '2460'), (6, NULL, '093')"


@query(dealt_sql("SELECT * FROM (VALUES (1, 20240231, 32400000000), (2, NULL, 34200000000), (3, 20240305, 34215500000), (4, NULL, 34215000000), (5, 20240305, NULL), (6, NULL, NULL)) v(i, day, micros)", 6))
def date_time_keys(spark, d):
    told = dealt(spark, d, _DATES, "i, a, b", 6).select("i", D.date_key(F.col("a")).alias("day"), D.time_key(F.col("b")).alias("micros"))
    return told.groupBy("i", "day", "micros").agg(F.count("*").alias("n"))


# -- review records and time windows

_METRICS = "(1, 'Mean Dice coefficient'), (2, 'AUROC'), (3, 'accuracy (%)'), (4, 'RMSE'), (5, 'true positive rate'), (6, ''), (7, 'frame rate'), (8, 'IoU')"


@query(dealt_sql("SELECT * FROM (VALUES (1, 'Dice', 1, 'Overlap-based (F1/Dice)'), (2, 'AUC', 1, 'Ranking-based (AUC)'), (3, 'Accuracy', 1, 'Accuracy'), (4, 'RMSE', -1, 'Other'), (5, 'Sensitivity', 1, 'Other'), (6, 'Unknown', 1, 'Other'), (7, 'Frame Rate', 1, 'Other'), (8, 'IoU', 1, 'Overlap-based (IoU)')) v(i, name, polarity, family)", 8))
def metric_names(spark, d):
    rows = dealt(spark, d, _METRICS, "i, raw", 8)
    told = rows.select("i", W.metric(F.col("raw")).alias("m"), W.metric_family(F.col("raw")).alias("family")).select("i", "m.name", "m.polarity", "family")
    return told.groupBy("i", "name", "polarity", "family").agg(F.count("*").alias("n"))


_GATES = "(1, 'pass', 'pass'), (2, 'fail', NULL), (3, 'pass', 'fail'), (4, 'uncertain', NULL), (5, NULL, NULL), (6, 'pass', 'uncertain'), (7, 'pass', NULL)"


@query(dealt_sql("SELECT * FROM (VALUES (1, 'INCLUDE', NULL, false), (2, 'EXCLUDE', 'inclusion', false), (3, 'EXCLUDE', 'exclusion', false), (4, 'UNCERTAIN', 'inclusion', true), (5, 'ERROR', 'inclusion', true), (6, 'UNCERTAIN', 'inclusion', true), (7, 'ERROR', 'exclusion', true)) v(i, decision, failed_at, flagged)", 7))
def screening_states(spark, d):
    told = W.screen(dealt(spark, d, _GATES, "i, inclusion, exclusion", 7))
    return told.groupBy("i", "decision", "failed_at", "flagged").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT lang, quality AS q, toxic AS t FROM documents JOIN labels USING (doc_id)), i AS (SELECT lang, 'good' AS item, q AS y FROM c UNION ALL SELECT lang, 'clean', 1 - t FROM c)
  SELECT lang, item, sum(y)::BIGINT AS yes, sum(1 - y)::BIGINT AS no, 0::BIGINT AS na, avg(y) AS proportion FROM i GROUP BY lang, item""")
def checklist_adherence(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels"), "doc_id")
    yes = lambda c: F.when(c, "Yes").otherwise("No")
    return W.adherence(docs.withColumn("m", F.create_map(F.lit("good"), yes(F.col("quality") == 1), F.lit("clean"), yes(F.col("toxic") == 0))), "m", ["lang"]).drop("low", "high")


@query("""WITH b AS (SELECT * FROM (VALUES ('view', 1), ('signup', 2), ('purchase', 3), ('error', 4), ('refund', 5)) v(question, position)), k AS (SELECT DISTINCT user_id FROM events),
  a AS (SELECT user_id, event_type, min(event_id::VARCHAR) AS answer FROM events GROUP BY 1, 2) SELECT k.user_id, question, position, coalesce(answer, 'n/a') AS answer FROM k CROSS JOIN b LEFT JOIN a ON a.user_id = k.user_id AND a.event_type = b.question""")
def align_bank(spark, d):
    bank = spark.sql("SELECT * FROM VALUES ('view', 1), ('signup', 2), ('purchase', 3), ('error', 4), ('refund', 5) AS v(question, position)")
    answers = read(spark, d, "events").select("user_id", F.col("event_type").alias("question"), F.col("event_id").cast("string").alias("answer"))
    return W.align_to_bank(answers, bank, "user_id")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from ..streaming.ingest import windowed

    return windowed(read(spark, d, "events"), "ts", "event_type", "value", width="6 hours")


@query("""WITH r AS (SELECT a.vec_id, a.label, min(r) FILTER (b_label = label) AS first FROM (SELECT a.vec_id, a.label, b.label AS b_label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS r
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) a GROUP BY 1, 2)
  SELECT count(*) AS n, avg((first <= 1)::INTEGER) AS r1, avg((first <= 5)::INTEGER) AS r5, avg((first <= 10)::INTEGER) AS r10, quantile_disc(first, 0.5) AS median_rank FROM r""")
def recall_at_k(spark, d):
    """Rank of the first neighbour of the same label, for the items whose id is divisible by 20."""
    items = read(spark, d, "embeddings")
    first = R.first_match_rank(items.where("vec_id % 20 = 0"), items)
    return first.agg(F.count("*").alias("n"), *[F.avg((F.col("first") <= k).cast("int")).alias(f"r{k}") for k in (1, 5, 10)], F.percentile_approx("first", 0.5, 1_000_000).cast("long").alias("median_rank"))
