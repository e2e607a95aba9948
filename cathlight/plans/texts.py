"""Queries over report and answer text, keys and values of table columns; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as T
from ..functions import values as D
from ..operators import evaluate as E
from ..operators import review as W
from .catalog import _TIDY, query, read

quoted = lambda s: "'" + s.replace("'", "''") + "'"
either = lambda patterns: quoted("|".join(f"(?:{p})" for p in patterns))
_REPLY = "CASE (conv_id + turn) % 6 WHEN 0 THEN 'No evidence of stenosis: ' || text WHEN 1 THEN text || ' is seen' WHEN 2 THEN ' Yes' WHEN 3 THEN 'Not stated. ' || text WHEN 4 THEN '\"n\"' ELSE text END"
_S = _TIDY.format(c="""regexp_replace(regexp_replace(reply, '^\\s+|\\s+$', '', 'g'), '^(?:"(.*)"|''(.*)'')$', '\\1\\2')""")


@query(f"""WITH t AS (SELECT {_S} AS s FROM (SELECT {_REPLY} AS reply FROM conversations)) SELECT CASE WHEN s IN ('', 'na', 'n/a', 'n\\a', 'none', 'null') OR regexp_matches(s, {either(A.NA_PHRASES)}) THEN 'n/a' WHEN regexp_matches(s, {either(A.NO_PHRASES)}) THEN 'no'
  WHEN regexp_matches(s, {either(A.YES_PHRASES)}) THEN 'yes' WHEN regexp_matches(s, '\\bno\\b') AND regexp_matches(s, {quoted(A.NO_NEAR)}) THEN 'no' ELSE 'n/a' END AS label, count(*) AS n FROM t GROUP BY 1""")
def strict_labels(spark, d):
    return read(spark, d, "conversations").select(F.expr(_REPLY).alias("reply")).groupBy(A.strict_label(F.col("reply")).alias("label")).agg(F.count("*").alias("n"))


_CASES = " ".join(f"WHEN {' OR '.join(f'contains(q, {quoted(n)})' for n in needles)} THEN {quoted(g)}" for g, needles in A.GROUPS)


@query(f"WITH q AS (SELECT lower(p_name || CASE p_size % 4 WHEN 0 THEN ' Stent in place' WHEN 1 THEN ' vessel patent' WHEN 2 THEN ' tumor seen' ELSE '' END) AS q FROM part) SELECT CASE {_CASES} ELSE 'OTHER' END AS grp, count(*) AS n FROM q GROUP BY 1")
def question_groups(spark, d):
    tail = F.when(F.col("p_size") % 4 == 0, " Stent in place").when(F.col("p_size") % 4 == 1, " vessel patent").when(F.col("p_size") % 4 == 2, " tumor seen").otherwise("")
    return read(spark, d, "part").groupBy(A.question_group(F.concat("p_name", tail)).alias("grp")).agg(F.count("*").alias("n"))


@query(f"WITH q AS (SELECT {_TIDY.format(c='''p_name || CASE WHEN p_size % 2 = 0 THEN '  Please state YES or no. ' ELSE '?' END''')} AS q FROM part) SELECT trim(CASE WHEN ends_with(q, {quoted(A.SUFFIX)}) THEN left(q, length(q) - {len(A.SUFFIX)}) ELSE q END) AS question, count(*) AS n FROM q GROUP BY 1")
def question_keys(spark, d):
    tail = F.when(F.col("p_size") % 2 == 0, "  Please state YES or no. ").otherwise("?")
    return read(spark, d, "part").groupBy(A.question_key(F.concat("p_name", tail)).alias("question")).agg(F.count("*").alias("n"))


_TERMS = f"CASE WHEN n_chars % 9 = 0 THEN NULL WHEN n_chars % 9 = 1 THEN 'Positive' WHEN n_chars % 9 = 2 THEN ' Not  Visible ' WHEN n_chars % 9 = 3 THEN '1.0' WHEN n_chars % 9 = 4 THEN 'Yes.' WHEN n_chars % 9 = 5 THEN 'n' WHEN n_chars % 9 = 6 THEN 'No, but ' || lang WHEN n_chars % 9 = 7 THEN 'present in ' || source ELSE lang END"


@query(f"""WITH a AS (SELECT {_TIDY.format(c=f"({_TERMS})")} AS t FROM documents), b AS (SELECT CASE WHEN {A.clause_of("t", A.TRUE_TERMS)} THEN 'YES' WHEN {A.clause_of("t", A.UNSURE + A.FALSE_TERMS)} THEN 'NO' WHEN contains(t, 'yes') OR contains(t, 'present') OR contains(t, 'positive') THEN 'YES' ELSE 'NO' END AS truth,
  CASE WHEN {A.clause_of("t", A.BINARY_TERMS)} OR coalesce(try_cast(t AS DOUBLE) = 1, false) THEN 1 ELSE 0 END AS bin, CASE WHEN regexp_extract(t, '^([a-z0-9]+)', 1) IN ('yes', 'y', 'true', '1') THEN 'yes' WHEN regexp_extract(t, '^([a-z0-9]+)', 1) IN ('no', 'n', 'false', '0') THEN 'no' END AS token FROM a)
  SELECT truth, bin, token, count(*) AS n FROM b GROUP BY ALL""")
def answers_of_documents(spark, d):
    return read(spark, d, "documents").select(F.expr(_TERMS).alias("a")).groupBy(A.truth_answer(F.col("a")).alias("truth"), A.binary(F.col("a")).alias("bin"), A.first_token(F.col("a")).alias("token")).agg(F.count("*").alias("n"))


@query(f"""SELECT lang, sum(length(regexp_replace(regexp_replace(text, {quoted("(?ims)(?:" + "|".join(T.CLOSINGS) + ").*\\z")}, ''), ' +\\z', ''))) AS chars, count_if(regexp_matches(text, {quoted("(?ims)(?:" + "|".join(T.CLOSINGS) + ")")})) AS cut FROM documents WHERE text IS NOT NULL GROUP BY lang""")
def closings_cut(spark, d):
    own = read(spark, d, "documents").where("text is not null")
    return own.groupBy("lang").agg(F.sum(F.length(T.cut_closing(F.col("text")))).alias("chars"), F.count_if(F.col("text").rlike("(?ims)(?:" + "|".join(T.CLOSINGS) + ")")).alias("cut"))


@query("""SELECT o_custkey, string_agg(u, '|' ORDER BY u) AS uids FROM (SELECT DISTINCT o_custkey, o_orderkey::VARCHAR AS u FROM orders) GROUP BY o_custkey""")
def uid_lists(spark, d):
    text = F.concat(F.lit("['"), F.array_join(F.transform(F.collect_set("o_orderkey"), lambda x: x.cast("string")), "',\n '"), F.lit("', ]"))
    lists = read(spark, d, "orders").groupBy("o_custkey").agg(text.alias("t"))
    return lists.select("o_custkey", F.array_join(F.array_sort(T.uid_list(F.col("t"))), "|").alias("uids"))


@query("""SELECT token, count(*) AS n FROM (SELECT unnest([p_brand, p_type, p_name]) AS token FROM part) GROUP BY token""")
def separated_tokens(spark, d):
    own = read(spark, d, "part").select(F.concat("p_brand", F.lit("; nan |"), "p_type", F.lit("\t, ,NA;"), "p_name").alias("t"))
    return own.select(F.explode(T.tokens(F.col("t"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("""SELECT page_id, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^\\s+|\\s+$', '', 'g'), '\\s+', '_', 'g'), '[^A-Za-z0-9._-]', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), 150) AS folder FROM pages""")
def folder_names(spark, d):
    return read(spark, d, "pages").select("page_id", T.directory_name(F.col("url")).alias("folder"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d')::BIGINT AS day, CASE WHEN o_orderkey % 24 < 24 THEN (o_orderkey % 24 * 60 + o_orderkey % 60) * 60000000 END AS micros FROM orders""")
def date_and_time_keys(spark, d):
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    time = F.format_string("%02d:%02d", F.col("o_orderkey") % 24, F.col("o_orderkey") % 60)
    return read(spark, d, "orders").select("o_orderkey", D.date_key(day).alias("day"), D.time_key(time).alias("micros"))


@query("""SELECT event_id, CASE WHEN value / 100 <= 1 THEN least(greatest(value, 0), 100) ELSE least(greatest(value / 100, 0), 100) END AS pct, CASE WHEN event_id % 7 >= 1 THEN event_id % 7 - 1 ELSE -1 END AS at,
  CASE WHEN event_type = 'click' THEN 'CLICK' ELSE 'Non-CLICK' END AS side, [event_type, 'x'] AS parts FROM events WHERE value IS NOT NULL""")
def scalar_values(spark, d):
    own = read(spark, d, "events").where("value is not null")
    return own.select("event_id", D.share(F.col("value") / 100).alias("pct"), D.index0((F.col("event_id") % 7).cast("string")).alias("at"), D.institution(F.col("event_type"), "click").alias("side"), D.listed(F.concat("event_type", F.lit(", x"))).alias("parts"))


@query("""SELECT p_brand, substr(sha1(string_agg(DISTINCT p_type, '|' ORDER BY p_type)), 1, 8) AS hash, least(6, ceil(sqrt(count(*))))::INTEGER AS columns, ceil(count(*) / least(6, ceil(sqrt(count(*)))))::INTEGER AS rows FROM part GROUP BY p_brand""")
def list_hashes_and_grids(spark, d):
    got = read(spark, d, "part").groupBy("p_brand").agg(D.list_hash(F.sort_array(F.collect_set("p_type"))).alias("hash"), F.count("*").alias("n"))
    return got.select("p_brand", "hash", D.grid(F.col("n")).alias("g")).select("p_brand", "hash", "g.columns", "g.rows")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, row_number() OVER w AS pos, min(l_extendedprice) OVER w AS best, l_extendedprice AS x, min(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
  FROM (SELECT l_orderkey, l_linenumber, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING))
  SELECT l_orderkey, l_linenumber, best, pos - max(CASE WHEN prior IS NULL OR x < prior THEN pos END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS since FROM v""")
def improvement_streaks(spark, d):
    own = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_extendedprice").alias("x"))
    return E.streak(own, "l_orderkey", "l_linenumber", "x").select("l_orderkey", "l_linenumber", "best", F.col("since").cast("long").alias("since"))


@query("""WITH d AS (SELECT l_returnflag, l_tax - l_discount AS d FROM lineitem) SELECT l_returnflag, count(*) AS n, round(avg(d), 9) AS mean_delta, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, avg((d > 0)::INTEGER) AS improved FROM d GROUP BY 1""")
def paired_differences(spark, d):
    return E.paired_t(read(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_tax").select("l_returnflag", "n", F.round("mean_delta", 9).alias("mean_delta"), F.round("t", 6).alias("t"), "improved")


@query("""SELECT l_linestatus, l_returnflag, count(*) AS n, min(l_quantity) AS lowest, max(l_quantity) AS highest, avg(l_quantity) AS mean, var_samp(l_quantity) AS variance FROM lineitem GROUP BY ALL""")
def described_groups(spark, d):
    return E.describe(read(spark, d, "lineitem"), "l_quantity", ["l_linestatus", "l_returnflag"]).select("l_linestatus", "l_returnflag", "n", "lowest", "highest", "mean", "variance")


@query("""SELECT 'user' AS path, count_if(role = 'user') AS yes, count_if(role <> 'user') AS no, count(*) FILTER (role IS NULL) AS missing FROM conversations UNION ALL
  SELECT 'even', count_if(role = 'user' AND conv_id % 2 = 0), count_if(role = 'user' AND conv_id % 2 <> 0), count(*) FILTER (role <> 'user' OR role IS NULL) FROM conversations""")
def boolean_profiles(spark, d):
    own = read(spark, d, "conversations").select((F.col("role") == "user").alias("user"), F.when(F.col("role") == "user", F.col("conv_id") % 2 == 0).alias("even"))
    return W.boolean_profile(own, ["user", "even"])


_CASED = "CASE doc_id % 4 WHEN 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 1 THEN replace(text, ' ', chr(10)) WHEN 2 THEN ' ' || text || ' FINDINGS: the Lesion I-A lead A1B [Phone] \"no.\" then IT is. \"so\" [x2] e' ELSE text END"
_LOW = "CASE WHEN regexp_matches(regexp_replace(w, '[^A-Za-z]', '', 'g'), '^[A-Z][A-Z]+$') THEN w ELSE lower(w) END"


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all({_CASED}, '[\\t-\\r ]+|[^\\t-\\r ]+') AS t FROM documents WHERE text IS NOT NULL),
  l AS (SELECT doc_id, t, list_transform(t, lambda w: {_LOW}) AS l FROM t),
  s AS (SELECT doc_id, array_to_string(list_transform(l, lambda w, i: CASE WHEN (i = 1 OR (i = 2 AND regexp_matches(t[1], '^[\\t-\\r ]')) OR contains(t[i - 1], chr(10)) OR (i > 2 AND regexp_matches(t[i - 1], '^[\\t-\\r ]') AND regexp_matches(t[i - 2], '[.!?]$')))
    AND regexp_matches(w, '^[a-z]') THEN upper(w[1]) || w[2:] ELSE w END), '') AS s FROM l)
  SELECT doc_id, length(s)::INTEGER AS n, md5(replace(replace(s, '[phone]', '[PHONE]'), '[x2]', '[X2]')) AS hash FROM s""")
def sentence_case(spark, d):
    own = read(spark, d, "documents").where("text is not null")
    cased = T.lower_sentences(F.expr(_CASED.replace("chr(10)", "char(10)")))
    return own.select("doc_id", cased.alias("s")).select("doc_id", F.length("s").alias("n"), F.md5("s").alias("hash"))
