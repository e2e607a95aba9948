"""Queries over cohort rules, completeness, splits, ordering and status tables; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cohort as H
from ..operators import curate as C
from ..operators import compare as P
from ..operators import order as O
from .catalog import query, read


@query("SELECT source, count(*) AS n FROM documents WHERE source LIKE 's_c1%' GROUP BY source")
def prefix_wildcard(spark, d):
    return read(spark, d, "documents").where(F.col("source").like("s_c1%")).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y%m%d') BETWEEN '19940101' AND '19961231' AND o_orderpriority IS NOT NULL GROUP BY o_orderstatus")
def date_range_text(spark, d):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return read(spark, d, "orders").where(day.between("19940101", "19961231") & F.col("o_orderpriority").isNotNull()).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT count_if(NOT contains(lower(p_name), 'widget')) AS kept, count_if(contains(lower(p_name), 'widget')) AS skipped FROM part")
def keyword_exclusion(spark, d):
    other = F.contains(F.lower("p_name"), F.lit("widget"))
    return read(spark, d, "part").agg(F.count_if(~other).alias("kept"), F.count_if(other).alias("skipped"))


_REPLY = "CASE WHEN doc_id % 5 = 0 THEN 'Maybe' WHEN toxic = 1 THEN ' YES' || chr(10) ELSE chr(9) || 'No' END"


@query(f"WITH a AS (SELECT lower(regexp_replace({_REPLY}, '^\\s+|\\s+$', '', 'g')) AS a FROM labels) SELECT a AS answer, count(*) AS n, (SELECT count(*) FROM a) AS before, (SELECT count_if(a IN ('yes', 'no')) FROM a) AS after FROM a WHERE a IN ('yes', 'no') GROUP BY a")
def strict_yes_no(spark, d):
    answer = F.when(F.col("doc_id") % 5 == 0, "Maybe").when(F.col("toxic") == 1, " YES\n").otherwise("\tNo")
    own = read(spark, d, "labels").select(answer.alias("answer"))
    return H.keep_yes_no(own, "answer").groupBy("answer").agg(F.count("*").alias("n")).join(F.broadcast(H.yes_no_report(own, "answer")))


@query("SELECT l_returnflag, count(*) AS n, count_if(l_quantity < 10 OR l_quantity > 45) AS outliers, count_if(l_quantity > 48) AS large FROM lineitem GROUP BY l_returnflag")
def range_outliers(spark, d):
    text = F.col("l_quantity").cast("string")
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(H.outlier(text, 10, 45)).alias("outliers"), F.count_if(H.outlier(text, 0, 48)).alias("large"))


@query("""WITH s AS (SELECT l_orderkey, max(l_quantity) AS q, max(l_discount) AS dc, max(l_tax) AS t, count(*) AS n FROM lineitem GROUP BY l_orderkey)
  SELECT l_orderkey, q > 49 OR (dc >= 0.09)::INTEGER + (t >= 0.07)::INTEGER + (n >= 5)::INTEGER >= 2 AS hit,
  concat_ws(' | ', CASE WHEN q > 49 THEN 'quantity' END, CASE WHEN dc >= 0.09 THEN 'discount' END, CASE WHEN t >= 0.07 THEN 'tax' END, CASE WHEN n >= 5 THEN 'lines' END) AS triggers FROM s""")
def weak_and_strong_signals(spark, d):
    own = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("dc"), F.max("l_tax").alias("t"), F.count("*").alias("n"))
    rule = H.signals({"quantity": F.col("q") > 49}, {"discount": F.col("dc") >= 0.09, "tax": F.col("t") >= 0.07, "lines": F.col("n") >= 5})
    return own.select("l_orderkey", rule.alias("r")).select("l_orderkey", "r.hit", "r.triggers")


@query("""WITH s AS (SELECT user_id, avg(value) AS mean, stddev_pop(value) AS sd FROM events GROUP BY user_id) SELECT count(*) AS n, count_if(mean >= 80 AND mean <= 120 AND sd <= 90) AS inside FROM s""")
def threshold_box(spark, d):
    own = read(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return own.agg(F.count("*").alias("n"), F.count_if(H.inside_box({"mean": (80.0, 120.0), "sd": (None, 90.0)})).alias("inside"))


@query("""WITH f AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT CASE WHEN n IS NULL THEN 'missing' WHEN n < 2 THEN 'removed' ELSE 'kept' END AS reason, count(*) AS studies,
  count(*) FILTER (n = 2) AS exactly_two FROM orders LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY 1""")
def minimum_frames(spark, d):
    frames = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    own = read(spark, d, "orders").select("o_orderkey").join(frames, "o_orderkey", "left")
    return own.groupBy(H.frame_reason(F.col("n"), 2).alias("reason")).agg(F.count("*").alias("studies"), F.count_if(F.col("n") == 2).alias("exactly_two"))


@query("""SELECT o_orderpriority, count(*) AS n, count_if(o_orderstatus = 'F' AND o_totalprice < 50000) AS violations FROM orders GROUP BY o_orderpriority""")
def violation_flags(spark, d):
    bad = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 50_000)
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(bad).alias("violations"))


@query("""WITH s AS (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS v FROM orders GROUP BY 1)
  SELECT CASE WHEN v IS NULL THEN 'missing' WHEN v THEN 'visual' ELSE 'no_visual' END AS state, count(*) AS n FROM customer LEFT JOIN s ON o_custkey = c_custkey GROUP BY 1""")
def presence_partition(spark, d):
    targets = read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority")
    return H.presence(targets, rows, "k", F.col("o_orderpriority") == "1-URGENT").groupBy("state").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, coalesce(c_name, 'NOT FOUND') AS c_name, coalesce(n_name, 'NOT FOUND') AS n_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def three_table_lookup(spark, d):
    customers = read(spark, d, "customer").where("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey")
    nations = read(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    own = read(spark, d, "orders").select("o_orderkey", "o_custkey").join(customers.select("o_custkey", "c_nationkey"), "o_custkey", "left")
    return H.lookup(H.lookup(own, "o_custkey", customers, "c_name"), "c_nationkey", nations, "n_name").select("o_orderkey", "c_name", "n_name")


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 3) GROUP BY l_orderkey""")
def list_overlap(spark, d):
    lists = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    allowed = read(spark, d, "part").where("p_size <= 3").select(F.col("p_partkey").alias("part"))
    return H.any_listed(lists, "l_orderkey", "parts", allowed, "part").select("l_orderkey", F.size("parts").cast("long").alias("n"))


@query("""SELECT a.conv_id, a.text AS original, coalesce(b.role, '-') AS variant, coalesce(b.text, '-') AS augmented FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.role <> 'user' WHERE a.role = 'user'""")
def original_and_augmented(spark, d):
    return H.with_augmented(read(spark, d, "conversations"), "conv_id", "role", "text", "user")


@query("""SELECT conv_id, bool_or(role = 'system') AND bool_or(role = 'user') AND bool_or(role = 'assistant') AS complete,
  concat_ws(',', CASE WHEN NOT bool_or(role = 'system') THEN 'system' END, CASE WHEN NOT bool_or(role = 'user') THEN 'user' END, CASE WHEN NOT bool_or(role = 'assistant') THEN 'assistant' END) AS missing FROM conversations GROUP BY conv_id""")
def complete_sets(spark, d):
    return H.complete_keys(read(spark, d, "conversations"), "conv_id", "role", ["system", "user", "assistant"])


@query("""SELECT token, count(*) AS n, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS token FROM part) WHERE token <> '' GROUP BY token HAVING count(*) > 1""")
def repeated_tokens(spark, d):
    own = read(spark, d, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("token")).where("token <> ''")
    return own.groupBy("token").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("brands")).where("n > 1")


@query("""WITH f AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS studies, min(n) AS fewest, max(n) AS most, avg(n) AS mean FROM f""")
def frames_per_study(spark, d):
    frames = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return frames.agg(F.count("*").alias("studies"), F.min("n").alias("fewest"), F.max("n").alias("most"), F.avg("n").alias("mean"))


@query("""SELECT l_returnflag AS verdict, count(DISTINCT l_orderkey) AS sequences, count(*) AS frames, coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) AS finished, coalesce(sum(l_quantity) FILTER (l_linestatus = 'X'), 0) AS none FROM lineitem GROUP BY 1""")
def verdict_breakdown(spark, d):
    sums = lambda s: F.coalesce(F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity"))), F.lit(0.0))
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("verdict")).agg(F.count_distinct("l_orderkey").alias("sequences"), F.count("*").alias("frames"), sums("F").alias("finished"), sums("X").alias("none"))


@query("""SELECT c_mktsegment, year(o_orderdate) >= 1996 AS later, count_if(o_orderstatus = 'F') AS yes, count(*) AS n, count_if(o_orderstatus = 'F') / count(*) AS share FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def period_split(spark, d):
    own = read(spark, d, "orders").join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    yes = F.count_if(F.col("o_orderstatus") == "F")
    return own.groupBy("c_mktsegment", (F.year("o_orderdate") >= 1996).alias("later")).agg(yes.alias("yes"), F.count("*").alias("n"), (yes / F.count("*")).alias("share"))


@query("""SELECT coalesce(o_orderstatus, 'ALL') AS decision, count(*) AS n, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year, quantile_cont(year(o_orderdate), 0.5) AS middle FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())""")
def years_by_decision(spark, d):
    years = read(spark, d, "orders").select("o_orderstatus", F.year("o_orderdate").cast("long").alias("y"))
    got = years.groupingSets([["o_orderstatus"], []], "o_orderstatus").agg(F.count("*").alias("n"), F.min("y").alias("first_year"), F.max("y").alias("last_year"), F.median("y").alias("middle"))
    return got.select(F.coalesce("o_orderstatus", F.lit("ALL")).alias("decision"), "n", "first_year", "last_year", "middle")


@query("""WITH t AS (SELECT c_mktsegment, arg_min(c_name, c_custkey) FILTER (c_acctbal < 0) AS first_owing, arg_min(c_acctbal, c_custkey) AS first_balance FROM customer GROUP BY 1) SELECT * FROM t""")
def first_per_column(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").groupBy("c_mktsegment").agg(F.min_by(F.when(F.col("c_acctbal") < 0, F.col("c_name")), F.when(F.col("c_acctbal") < 0, k)).alias("first_owing"), F.min_by("c_acctbal", k).alias("first_balance"))


@query("""SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, status""")
def category_codes(spark, d):
    return read(spark, d, "orders").groupBy(H.coded(F.col("o_orderstatus"), {"F": "finished", "O": "open"}).alias("status")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


@query("""SELECT o_custkey, string_agg(o_orderkey || ':' || n, ' ' ORDER BY o_orderkey) AS studies FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def nested_study_list(spark, d):
    frames = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    own = read(spark, d, "orders").select("o_orderkey", "o_custkey").join(frames, "o_orderkey").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "n"))).alias("s"))
    return own.select("o_custkey", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["o_orderkey"], x["n"])), " ").alias("studies"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_totalprice < 100000 THEN NULL ELSE o_orderdate END ASC NULLS LAST, o_orderkey) AS place FROM orders""")
def chronological_order(spark, d):
    day = F.when(F.col("o_totalprice") >= 100_000, F.col("o_orderdate"))
    own = Window.partitionBy("o_custkey").orderBy(H.chronological(day, F.col("o_orderkey")))
    return read(spark, d, "orders").select("o_orderkey", F.row_number().over(own).cast("long").alias("place"))


@query("SELECT event_id, try_cast(props->>'$.k' AS BIGINT) AS k FROM events ORDER BY k DESC NULLS LAST, event_id LIMIT 20")
def cast_sort_limit(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return read(spark, d, "events").select("event_id", k.alias("k")).orderBy(F.desc_nulls_last("k"), "event_id").limit(20)


@query("""WITH t AS (SELECT lang, doc_id, toxic = 1 AS hit, row_number() OVER (PARTITION BY lang, toxic = 1 ORDER BY doc_id) AS turn FROM documents JOIN labels USING (doc_id))
  SELECT lang, doc_id, hit, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, hit DESC) AS place FROM t) WHERE place <= 5""")
def interleaved_examples(spark, d):
    own = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("hit")), "doc_id")
    return H.interleaved(own, "lang", "hit", "doc_id", 5).select("lang", "doc_id", "hit", F.col("place").cast("long").alias("place"))


_NAMES = "CASE WHEN p_size % 7 = 0 THEN 'last.pt' WHEN p_size % 5 = 0 THEN 'best.pt' ELSE 'epoch_' || p_size || '.pt' END"


@query(f"""WITH n AS (SELECT DISTINCT {_NAMES} AS name FROM part), k AS (SELECT name, try_cast(nullif(regexp_extract(name, 'epoch[_-]?(\\d+)', 1), '') AS INTEGER) AS e FROM n)
  SELECT name, row_number() OVER (ORDER BY CASE WHEN e IS NOT NULL THEN 0 WHEN contains(name, 'last') THEN 1 ELSE 2 END, coalesce(e, 0), name) AS place FROM k""")
def checkpoint_names(spark, d):
    name = F.when(F.col("p_size") % 7 == 0, "last.pt").when(F.col("p_size") % 5 == 0, "best.pt").otherwise(F.concat(F.lit("epoch_"), F.col("p_size"), F.lit(".pt")))
    names = read(spark, d, "part").select(name.alias("name")).distinct()
    return O.numbered(names, H.checkpoint_order(F.col("name")))


@query("""WITH v AS (SELECT l_orderkey, list_sort(list(l_extendedprice)) AS x FROM lineitem GROUP BY 1)
  SELECT l_orderkey, list_avg(list_reverse(x)[1:2]) AS top, list_median(x) AS median, list_avg(list_reverse(x)[1:2]) / (list_median(x) + 1e-6) AS ratio FROM v""")
def top_against_median(spark, d):
    own = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_extendedprice").alias("x"))
    return own.select("l_orderkey", H.top_against_median(F.col("x"), 2).alias("t")).select("l_orderkey", "t.top", "t.median", "t.ratio")


@query("""WITH n AS (SELECT l_orderkey, count(*)::INTEGER AS n, ceil(count(*) * 0.4)::INTEGER AS k FROM lineitem GROUP BY 1)
  SELECT l_orderkey, array_to_string(list_sort(list_distinct(CASE WHEN k = 1 THEN [0] ELSE list_transform(range(k), lambda i: floor(i * (n - 1) / (k - 1))::INTEGER) END)), ',') AS picks FROM n""")
def fractional_subset(spark, d):
    own = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return own.select("l_orderkey", F.array_join(H.subset_indices(F.col("n"), 0.4), ",").alias("picks"))


@query("""WITH m AS (SELECT l_orderkey, avg(l_discount) AS discount, avg(l_tax) AS tax, avg(l_quantity) / 500 AS quantity FROM lineitem GROUP BY 1)
  SELECT l_orderkey, CASE WHEN discount >= tax AND discount >= quantity THEN 'discount' WHEN tax >= quantity THEN 'tax' ELSE 'quantity' END AS name, round(greatest(discount, tax, quantity) - tax, 9) AS delta FROM m""")
def best_feature_set(spark, d):
    own = H.means_as_read(read(spark, d, "lineitem"), "l_orderkey", ["l_discount", "l_tax", "l_quantity"])
    own = own.select("l_orderkey", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), (F.col("l_quantity") / 500).alias("quantity"))
    return own.select("l_orderkey", H.best_of(["discount", "tax", "quantity"], "tax").alias("b")).select("l_orderkey", "b.name", F.round("b.delta", 9).alias("delta"))


_HASH = "('0x' || substr(md5('0|' || {k}), 1, 8))::BIGINT"


@query(f"SELECT {_HASH.format(k='o_custkey')} % 5 AS fold, count(*) AS n, count(DISTINCT o_custkey) AS patients FROM orders GROUP BY 1")
def group_k_fold(spark, d):
    return H.group_folds(read(spark, d, "orders"), "o_custkey", 5).groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("patients"))


@query(f"""SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY {_HASH.format(k='event_id')}, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE rn <= greatest(1, round_even(n * 0.03, 0))""")
def kept_share(spark, d):
    return H.keep_share(read(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id", 0.03)


@query("""WITH k AS (SELECT unnest(['system', 'user', 'tool', 'assistant']) AS r, unnest([1, 2, 3, 4]) AS i), c AS (SELECT DISTINCT conv_id FROM conversations), f AS (SELECT conv_id, role, substr(max(text), 1, 6) AS t FROM conversations WHERE text IS NOT NULL GROUP BY ALL)
  SELECT c.conv_id, string_agg(coalesce(f.t, 'n/a'), '|' ORDER BY i) AS row FROM c CROSS JOIN k LEFT JOIN f ON f.conv_id = c.conv_id AND f.role = k.r GROUP BY c.conv_id""")
def fixed_key_list(spark, d):
    per = read(spark, d, "conversations").groupBy("conv_id", "role").agg(F.max("text").alias("t"))
    own = per.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "t"))).alias("m"))
    keys = F.array(*map(F.lit, ("system", "user", "tool", "assistant")))
    return own.select("conv_id", F.array_join(H.fixed_keys(F.col("m"), keys, "n/a", 6), "|").alias("row"))


@query("""SELECT lang, count(*) AS open, min(done) AS done, min(total) AS total FROM (SELECT d.lang, l.doc_id, (SELECT count(*) FROM labels WHERE toxic = 0) AS done, (SELECT count(*) FROM documents) AS total FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 0) WHERE doc_id IS NULL GROUP BY lang""")
def labelling_queue(spark, d):
    queue = H.work_queue(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels"), "doc_id", "toxic", 0)
    return queue.groupBy("lang").agg(F.count("*").alias("open"), F.min("done").alias("done"), F.min("total").alias("total"))


@query("""SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM (SELECT CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) GROUP BY 1""")
def update_and_delete(spark, d):
    left = H.delete_ids(read(spark, d, "orders"), read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
    return H.update_where(left, F.col("o_totalprice") > 400_000, {"o_orderstatus": F.lit("X")}).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("SELECT 'rad-dino' AS embedding_model, count(*) AS n, count(label) AS labelled FROM embeddings")
def key_column_added(spark, d):
    once = H.with_key_column(read(spark, d, "embeddings"), "embedding_model", "rad-dino")
    return H.with_key_column(once, "embedding_model", "other").groupBy("embedding_model").agg(F.count("*").alias("n"), F.count("label").alias("labelled"))


@query("""WITH s AS (SELECT l_orderkey, CASE max(l_returnflag) WHEN 'N' THEN 'completed' WHEN 'R' THEN 'error' ELSE 'in_progress' END AS status FROM lineitem GROUP BY 1)
  SELECT coalesce(status, 'new') AS status, count(*) AS n FROM orders LEFT JOIN s ON l_orderkey = o_orderkey WHERE status IS DISTINCT FROM 'completed' GROUP BY 1""")
def retry_states(spark, d):
    state = F.when(F.max("l_returnflag") == "N", "completed").when(F.max("l_returnflag") == "R", "error").otherwise("in_progress")
    status = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(state.alias("status"))
    left = H.to_do(read(spark, d, "orders").select("o_orderkey"), status, "o_orderkey").join(status, "o_orderkey", "left")
    return left.groupBy(F.coalesce("status", F.lit("new")).alias("status")).agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT doc_id, CASE WHEN toxic = 1 THEN CASE WHEN n_chars > 1500 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN n_chars > 1500 THEN 'FP' ELSE 'TN' END END AS outcome FROM documents JOIN labels USING (doc_id)) SELECT outcome, count(*) AS n FROM w GROUP BY outcome""")
def pooled_confusion(spark, d):
    own = read(spark, d, "documents").select("doc_id", (F.col("n_chars") > 1500).alias("p")).join(read(spark, d, "labels"), "doc_id")
    return P.pooled_confusion(own.where("toxic = 1"), own.where("toxic = 0"), "doc_id", "p").groupBy("outcome").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderstatus, n, round_even(n * 0.8, 0)::BIGINT AS train, n - round_even(n * 0.8, 0)::BIGINT AS held, (n + 4) // 5 AS fold0, least(n, 40) AS sampled FROM c""")
def stratified_sizes(spark, d):
    own = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    cut = C.holdout(own, "o_orderkey", "o_orderstatus", 0.8).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if("train").alias("train"), F.count_if(~F.col("train")).alias("held"))
    folds = C.stratified_folds(own, "o_orderkey", "o_orderstatus", 5).where("fold = 0").groupBy("o_orderstatus").agg(F.count("*").alias("fold0"))
    some = C.sample_strata(own, "o_orderkey", "o_orderstatus", lambda n: F.least(n, F.lit(40))).groupBy("o_orderstatus").agg(F.count("*").alias("sampled"))
    return cut.join(folds, "o_orderstatus").join(some, "o_orderstatus")


@query("""WITH p AS (SELECT count(DISTINCT o_custkey) AS k FROM orders) SELECT greatest(1, least(k - 1, round_even(k * 0.2, 0)::BIGINT)) AS dev, k - greatest(1, least(k - 1, round_even(k * 0.2, 0)::BIGINT)) AS train, 0 AS both FROM p""")
def group_split_sizes(spark, d):
    sides = C.split_groups(read(spark, d, "orders").select("o_custkey"), "o_custkey", 0.2).groupBy("o_custkey").agg(F.bool_or("dev").alias("any"), F.bool_and("dev").alias("all"))
    return sides.agg(F.count_if("all").alias("dev"), F.count_if(~F.col("any")).alias("train"), F.count_if(F.col("any") & ~F.col("all")).cast("int").alias("both"))


_WORD = "concat(CASE WHEN doc_id % 3 = 0 THEN chr(9) ELSE '' END, doc_id % 1000, CASE WHEN doc_id % 2 = 0 THEN '.0' ELSE '' END, chr(10))"


@query(f"SELECT regexp_replace(regexp_replace({_WORD}, '^\\s+|\\s+$', '', 'g'), '^(\\d+)\\.0$', '\\1') AS key, count(*) AS n FROM documents GROUP BY 1")
def scalar_keys(spark, d):
    from ..functions import text as T

    i = F.col("doc_id")
    raw = F.concat(F.when(i % 3 == 0, "\t").otherwise(""), (i % 1000).cast("string"), F.when(i % 2 == 0, ".0").otherwise(""), F.lit("\n"))
    return read(spark, d, "documents").groupBy(T.key_text(raw).alias("key")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, nullif(regexp_extract(regexp_replace(url, '/+$', ''), '^(.*)/[^/]*$', 1), '') AS parent, string_split(regexp_replace(url, '/+$', ''), '/')[-1] AS base FROM pages WHERE url IS NOT NULL""")
def path_parts(spark, d):
    from ..functions import text as T

    return read(spark, d, "pages").where("url is not null").select("page_id", T.parent(F.col("url")).alias("parent"), T.basename(F.col("url")).alias("base"))


@query("""WITH y AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text || CASE doc_id % 4 WHEN 0 THEN ' in 1997' WHEN 1 THEN ' 2003-2041, 1895 and 1993' WHEN 2 THEN ' 1989 2035' ELSE '' END, '\\b((?:19|20)\\d{2})\\b', 1), lambda x: x::INTEGER), lambda x: x BETWEEN 1990 AND 2035) AS y FROM documents WHERE text IS NOT NULL) SELECT len(y) AS years, count(*) AS n, min(y[1]) AS first_year FROM y GROUP BY 1""")
def years_in_text(spark, d):
    from ..functions import values as D

    own = read(spark, d, "documents").where("text is not null").select(D.years_in(F.expr("text || CASE doc_id % 4 WHEN 0 THEN ' in 1997' WHEN 1 THEN ' 2003-2041, 1895 and 1993' WHEN 2 THEN ' 1989 2035' ELSE '' END")).alias("y"))
    return own.groupBy(F.size("y").cast("long").alias("years")).agg(F.count("*").alias("n"), F.min(F.get("y", F.lit(0))).alias("first_year"))
