"""Queries over model comparisons, averages and controls; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as D
from ..operators import compare as P
from .catalog import _PRED, predictions, query, read

_ERFC = "-1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))"
_PAIRS = f"""WITH p AS (SELECT doc_id, m, toxic = p AS ok FROM {_PRED}),
  c AS (SELECT x.m AS baseline, y.m AS tuned, count(*) AS n, count_if(x.ok AND y.ok) AS both_right, count_if(x.ok AND NOT y.ok) AS b, count_if(NOT x.ok AND y.ok) AS c, count_if(NOT x.ok AND NOT y.ok) AS both_wrong
    FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.m = 'even' AND y.m <> 'even' GROUP BY ALL),
  s AS (SELECT *, (both_right + b) / n AS baseline_accuracy, (both_right + c) / n AS tuned_accuracy, (c - b) / n AS delta, CASE WHEN b + c > 0 THEN (abs(b - c) - 1.0) ^ 2 / (b + c) ELSE 0 END AS chi_square FROM c),
  z AS (SELECT *, sqrt(chi_square / 2) AS z, 1 / (1 + 0.5 * sqrt(chi_square / 2)) AS t FROM s), q AS (SELECT * EXCLUDE (z, t), CASE WHEN b + c = 0 THEN 1 ELSE t * exp(-z * z + {_ERFC}) END AS p FROM z)"""


@query(f"""{_PAIRS} SELECT baseline, tuned, n, both_right, b, c, both_wrong, round(baseline_accuracy, 9) AS baseline_accuracy, round(tuned_accuracy, 9) AS tuned_accuracy, round(delta, 9) AS delta, round(chi_square, 6) AS chi_square, round(p, 6) AS p,
  CASE WHEN p >= 0.05 THEN 'none' WHEN delta > 0 THEN 'tuned' WHEN delta < 0 THEN 'baseline' ELSE 'none' END AS winner, CASE WHEN p < 0.05 AND delta > 0 THEN 0 WHEN p < 0.05 THEN 1 ELSE 2 END AS priority, 'ok' AS status FROM q ORDER BY priority, p, delta DESC""")
def model_pairs(spark, d):
    got = P.ranked(P.compare_pairs(predictions(spark, d), ["doc_id"], "m", "toxic", "p", F.col("m") != "even"))
    return got.withColumns({**{c: F.round(c, 9) for c in ("baseline_accuracy", "tuned_accuracy", "delta")}, **{c: F.round(c, 6) for c in ("chi_square", "p")}})


@query(f"""WITH w AS (SELECT lang, avg((p = toxic)::INTEGER) AS a, count(*) AS n, sum((p = toxic)::INTEGER) AS ok FROM {_PRED} WHERE m = 'long' GROUP BY lang)
  SELECT lang AS label, n, a AS accuracy FROM w UNION ALL SELECT 'MICRO', sum(n)::BIGINT, sum(ok) / sum(n) FROM w UNION ALL SELECT 'MACRO', sum(n)::BIGINT, avg(a) FROM w""")
def micro_and_macro(spark, d):
    return P.micro_macro(predictions(spark, d).where("m = 'long'"), "lang", F.col("p") == F.col("toxic"))


@query(f"""WITH f AS (SELECT m, doc_id % 5 AS fold, avg((p = toxic)::INTEGER) AS a FROM {_PRED} GROUP BY ALL) SELECT m, count(*) AS folds, avg(a) AS mean, stddev_pop(a) AS sd FROM f GROUP BY m""")
def accuracy_over_folds(spark, d):
    return P.over_folds(predictions(spark, d).withColumn("fold", F.col("doc_id") % 5), ["m"], "fold", F.col("p") == F.col("toxic"))


@query("""WITH m AS (SELECT l_returnflag, avg(l_extendedprice) FILTER (l_linestatus = 'F') AS with_mean, avg(l_extendedprice) FILTER (l_linestatus <> 'F') AS without_mean FROM lineitem GROUP BY 1)
  SELECT l_returnflag, round(with_mean, 4) AS with_mean, round(without_mean, 4) AS without_mean, round(with_mean - without_mean, 4) AS delta, round(without_mean - with_mean, 4) AS gain,
  CASE WHEN without_mean > with_mean THEN 'better' WHEN without_mean < with_mean THEN 'worse' WHEN without_mean = with_mean THEN 'same' END AS direction FROM m""")
def with_and_without(spark, d):
    got = P.with_and_without(read(spark, d, "lineitem"), ["l_returnflag"], F.col("l_linestatus") == "F", "l_extendedprice", F.lit(-1))
    return got.withColumns({c: F.round(c, 4) for c in ("with_mean", "without_mean", "delta", "gain")})


@query("""WITH c AS (SELECT lang, count_if(toxic = 1) AS yes, count_if(toxic = 0) AS no FROM documents JOIN labels USING (doc_id) GROUP BY lang)
  SELECT lang, 'all_yes' AS control, 2 * yes / (2 * yes + no) AS f1_yes, 0.0::DOUBLE AS f1_no, yes / (2 * yes + no) AS f1_macro FROM c UNION ALL SELECT lang, 'all_no', 0.0, 2 * no / (2 * no + yes), no / (2 * no + yes) FROM c""")
def constant_controls(spark, d):
    return P.constant_controls(read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels"), "doc_id"), "lang", "toxic")


@query(f"""SELECT m, 'TP=' || count_if(p = 1 AND toxic = 1) || ' TN=' || count_if(p = 0 AND toxic = 0) || ' FP=' || count_if(p = 1 AND toxic = 0) || ' FN=' || count_if(p = 0 AND toxic = 1) AS tip, count_if(p = 1 AND toxic = 1) AS tp, count_if(p = 0 AND toxic = 1) AS fn FROM {_PRED} GROUP BY m""")
def confusion_tips(spark, d):
    from ..operators.evaluate import confusion

    tips = confusion(predictions(spark, d), ["m"], "toxic", "p").select("m", P.confusion_tip(*(F.col(c) for c in ("tp", "tn", "fp", "fn"))).alias("tip"))
    return tips.withColumn("r", P.parse_confusion_tip(F.col("tip"))).select("m", "tip", "r.tp", "r.fn")


@query("""SELECT o_orderkey, round(o_totalprice / 1000000, 8) AS accuracy, round((o_totalprice / 10000) / CASE WHEN o_totalprice / 10000 > 1 THEN 100 ELSE 1 END, 8) AS f1 FROM orders""")
def console_scores(spark, d):
    price = F.col("o_totalprice")
    text = F.concat(F.lit("Run\n accuracy: "), F.format_string("%.8f", price / 1_000_000), F.lit("\nF1 = "), F.format_string("%.6f", price / 10_000), F.lit("%\n"))
    scores = read(spark, d, "orders").select("o_orderkey", P.parse_scores(text, ["accuracy", "f1"]).alias("s"))
    return scores.select("o_orderkey", F.round(F.col("s")["accuracy"], 8).alias("accuracy"), F.round(F.col("s")["f1"], 8).alias("f1"))


@query("""WITH m AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) SELECT event_id, CASE WHEN hi = lo THEN 0 ELSE (value - lo) / (hi - lo) END AS scaled FROM events JOIN m USING (event_type) WHERE value IS NOT NULL""")
def min_max_scaled(spark, d):
    return D.min_max(read(spark, d, "events").select("event_id", "event_type", "value").where("value is not null"), ["event_type"], "value").select("event_id", "scaled")


@query("""WITH h AS (SELECT event_type, least(255, floor(value))::BIGINT AS b, count(*) AS c FROM events WHERE value BETWEEN 0 AND 255 GROUP BY ALL), t AS (SELECT event_type, sum(c) AS n FROM h GROUP BY 1)
  SELECT event_type, -sum(c / n * log2(c / n)) AS entropy FROM h JOIN t USING (event_type) GROUP BY event_type""")
def histogram_entropy(spark, d):
    return D.entropy_by(read(spark, d, "events"), ["event_type"], "value", 0, 255)


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.none.x'), 'unknown') AS x FROM events""")
def json_paths(spark, d):
    return read(spark, d, "events").select("event_id", D.path_or(F.col("props"), "$.k").alias("k"), D.path_or(F.col("props"), "$.none.x", "unknown").alias("x"))


@query("""SELECT coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END), ''), nullif(trim(CASE WHEN doc_id % 2 = 0 THEN source END), ''), 'row_' || lpad(doc_id::VARCHAR, 6, '0')) AS name, count(*) AS n FROM documents GROUP BY 1""")
def output_names(spark, d):
    lang, source = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")), F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return read(spark, d, "documents").groupBy(D.first_filled([lang, source], F.format_string("row_%06d", "doc_id")).alias("name")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, ts AS at FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 3 = 0""")
def zulu_times(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return read(spark, d, "events").select("event_id", D.zulu(text).alias("at"))


@query("""WITH t AS (SELECT DISTINCT conv_id, role FROM conversations) SELECT a.role AS a, b.role AS b, count(*) AS n FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.role < b.role GROUP BY ALL""")
def set_co_occurrence(spark, d):
    from ..operators.curate import co_occurrence

    return co_occurrence(read(spark, d, "conversations"), "conv_id", "role")
