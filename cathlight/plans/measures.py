"""Queries over quantiles, thresholds, significance and text overlap; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tiles as I
from ..operators import evaluate as E
from ..operators import fuzzy as Z
from ..operators import generated as N
from ..operators import probes as B
from ..operators import quantiles as Q
from ..operators import significance as G
from .catalog import query, read
from .comparison import _ERFC


@query("""SELECT event_type, p, count(value) AS n, CASE p WHEN 0.0 THEN quantile_cont(value, 0.0) WHEN 0.03 THEN quantile_cont(value, 0.03) WHEN 0.5 THEN quantile_cont(value, 0.5) WHEN 0.95 THEN quantile_cont(value, 0.95)
  ELSE quantile_cont(value, 1.0) END AS quantile FROM events, (SELECT unnest([0.0, 0.03, 0.5, 0.95, 1.0])::DOUBLE AS p) GROUP BY event_type, p""")
def quantiles_by_type(spark, d):
    return Q.quantiles(read(spark, d, "events"), "value", [0.0, 0.03, 0.5, 0.95, 1.0], ["event_type"])


@query("""SELECT 'price' AS name, quantile_cont(l_extendedprice::DOUBLE, 0.25) AS q1, quantile_cont(l_extendedprice::DOUBLE, 0.5) AS median, quantile_cont(l_extendedprice::DOUBLE, 0.97) AS high FROM lineitem
  UNION ALL SELECT 'signed', quantile_cont(x, 0.25), quantile_cont(x, 0.5), quantile_cont(x, 0.97) FROM (SELECT (l_quantity - 25) * l_extendedprice / 1e9 AS x FROM lineitem)""")
def quantiles_of_all(spark, d):
    own = read(spark, d, "lineitem")
    forms = F.array(F.struct(F.lit("price").alias("name"), F.col("l_extendedprice").cast("double").alias("x")), F.struct(F.lit("signed").alias("name"), ((F.col("l_quantity") - 25) * F.col("l_extendedprice") / 1e9).cast("double").alias("x")))
    return Q.wide_quantiles(own.select(F.inline(forms)), "x", {"q1": 0.25, "median": 0.5, "high": 0.97}, ["name"])


_FRAMES = """SELECT vec_id, label AS sequence, stddev_pop(x) AS std, avg(x) AS mean, avg((x > 0.15)::INTEGER) AS bright_frac, count(DISTINCT floor(x * 32)) AS entropy
  FROM (SELECT vec_id, vec_id % 97 AS label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL"""


@query(f"""WITH f AS ({_FRAMES}), c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY round(std, 12), vec_id) = 1)
  SELECT 'MASK_MAX_STD' AS name, round(max(round(std, 12)) * 1.15, 2) AS value FROM c UNION ALL SELECT 'MASK_MAX_MEAN', round(least(255.0, max(mean) * 1.15), 2) FROM c
  UNION ALL SELECT 'MASK_MIN_MEAN', round(quantile_cont(mean, 0.03) / 1.15, 2) FROM c UNION ALL SELECT 'MASK_MAX_BRIGHT_FRAC', round(least(1.0, max(bright_frac) * 1.15), 4) FROM c
  UNION ALL SELECT 'MASK_MAX_ENTROPY', round(max(entropy) * 1.15, 4) FROM c""")
def mask_thresholds(spark, d):
    cells = read(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 97).alias("sequence"), F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    frames = cells.groupBy("vec_id", "sequence").agg(F.round(F.stddev_pop("x"), 12).alias("std"), F.avg("x").alias("mean"), F.avg((F.col("x") > 0.15).cast("int")).alias("bright_frac"), F.count_distinct(F.floor(F.col("x") * 32)).cast("double").alias("entropy"))
    return Q.thresholds(frames, "sequence", "vec_id")


_THETA = "atan(abs(t) / sqrt(f))"
_T_TAIL = f"""CASE WHEN f % 2 = 1 THEN 1 - 2 / pi() * ({_THETA} + sin({_THETA}) * list_sum(list_concat([0.0::DOUBLE], list_transform(range((f - 1) // 2), lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5) + (2 * k + 1) * ln(cos({_THETA})))))))
  ELSE 1 - sin({_THETA}) * list_sum(list_transform(range(f // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) + 2 * k * ln(cos({_THETA}))) / sqrt(pi()))) END"""
_PAIRED = f"""WITH RECURSIVE w AS (SELECT 0 AS k, [1.0::DOUBLE] AS ways UNION ALL SELECT k + 1, list_transform(list_zip(list_concat(ways, list_transform(range(k + 1), lambda x: 0.0::DOUBLE)), list_concat(list_transform(range(k + 1), lambda x: 0.0::DOUBLE), ways)), lambda z: z[1] + z[2]) FROM w WHERE k < 50),
  v AS (SELECT metric, polarity, with_value AS w, without_value AS o, with_value - without_value AS d FROM pairs WHERE with_value IS NOT NULL AND without_value IS NOT NULL),
  g AS (SELECT metric, min(polarity) AS polarity, count(*) AS n_pairs, avg(w) AS mean_with, avg(o) AS mean_without, avg(d) AS mean_delta, stddev_samp(d) AS sd, 100 * avg((d * polarity > 0)::INTEGER) AS pct, count_if(d = 0) AS zeros FROM v GROUP BY metric HAVING count(*) > 1),
  r AS (SELECT metric, d, rank() OVER (PARTITION BY metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY metric, abs(d)) - 1) / 2 AS rank, count(*) OVER (PARTITION BY metric, abs(d)) AS c FROM v WHERE d <> 0),
  s AS (SELECT metric, count(*) AS n, least(sum(CASE WHEN d > 0 THEN rank ELSE 0 END), sum(CASE WHEN d < 0 THEN rank ELSE 0 END)) AS least, bool_or(c > 1) AS tied, sum(c * c - 1) AS cubes FROM r GROUP BY metric),
  e AS (SELECT *, abs(least - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - cubes / 48) / sqrt(2) AS z FROM s),
  p AS (SELECT g.*, mean_delta / nullif(sd, 0) * sqrt(n_pairs) AS t, n_pairs - 1 AS f, n, least, CASE WHEN n <= 50 AND zeros = 0 AND NOT tied THEN least(1.0, 2 * list_sum(ways[1:floor(least)::INTEGER + 1]) / 2 ^ n)
    WHEN n > 0 THEN least(1.0, (1 / (1 + 0.5 * z)) * exp(-z * z + {_ERFC.replace('t *', '(1 / (1 + 0.5 * z)) *')})) END AS p_wilcoxon FROM g LEFT JOIN e USING (metric) LEFT JOIN w ON k = n),
  q AS (SELECT *, {_T_TAIL} AS p_ttest FROM p)
  SELECT metric, polarity, n_pairs, round(mean_with, 7) AS mean_with, round(mean_without, 7) AS mean_without, round(mean_delta, 7) AS mean_delta, round(pct, 1) AS pct_improvement, least AS statistic,
  round(p_ttest, 4) AS p_ttest, round(p_wilcoxon, 4) AS p_wilcoxon, CASE WHEN coalesce(p_wilcoxon < 0.05, false) OR coalesce(p_ttest < 0.05, false) THEN 'Yes' ELSE 'No' END AS significant FROM q"""


def _paired(pairs):
    places = {"mean_with": 7, "mean_without": 7, "mean_delta": 7, "pct_improvement": 1, "p_ttest": 4, "p_wilcoxon": 4}
    return G.paired_tests(pairs, "metric", "with_value", "without_value", "polarity").withColumns({c: F.round(c, k) for c, k in places.items()}).select("metric", "polarity", "n_pairs", "mean_with", "mean_without", "mean_delta", "pct_improvement", "statistic", "p_ttest", "p_wilcoxon", "significant")


@query(_PAIRED.replace("FROM pairs", "FROM (SELECT 'part ' || l_partkey AS metric, CASE WHEN l_partkey % 3 = 0 THEN -1 ELSE 1 END AS polarity, l_extendedprice / 63 AS with_value, 30.0::DOUBLE * l_quantity AS without_value FROM lineitem)"))
def paired_tests_by_part(spark, d):
    own = read(spark, d, "lineitem")
    polarity = F.when(F.col("l_partkey") % 3 == 0, -1).otherwise(1)
    return _paired(own.select(F.concat(F.lit("part "), "l_partkey").alias("metric"), polarity.alias("polarity"), (F.col("l_extendedprice") / 63).alias("with_value"), (30.0 * F.col("l_quantity")).alias("without_value")))


@query(_PAIRED.replace("FROM pairs", "FROM (SELECT l_returnflag || l_linestatus AS metric, 1 AS polarity, CASE WHEN l_linenumber < 7 THEN floor(l_discount * 100) END AS with_value, floor(l_tax * 100) + l_suppkey % 3 AS without_value FROM lineitem)"))
def paired_tests_with_ties(spark, d):
    own = read(spark, d, "lineitem")
    value = F.when(F.col("l_linenumber") < 7, F.floor(F.col("l_discount") * 100)).cast("double")
    return _paired(own.select(F.concat("l_returnflag", "l_linestatus").alias("metric"), F.lit(1).alias("polarity"), value.alias("with_value"), (F.floor(F.col("l_tax") * 100) + F.col("l_suppkey") % 3).cast("double").alias("without_value")))


# each conversation's answer against its question
_TOLD = """SELECT conv_id || ':' || q.turn AS pair, q.text AS reference, a.text AS generated FROM conversations q JOIN (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant') a USING (conv_id) WHERE q.role = 'user' AND a.turn = q.turn + 1"""
_WORDS = """SELECT pair, s, list_filter(string_split_regex(lower(coalesce(CASE s WHEN 0 THEN reference ELSE generated END, '')), '{split}'), lambda w: w <> '') AS w FROM told, (VALUES (0), (1)) v(s)"""
_MATCHED = """m AS (SELECT pair, n, sum(least(a, b)) AS hits, sum(a) AS ours, sum(b) AS theirs FROM (SELECT pair, n, gram, count_if(s = 1) AS a, count_if(s = 0) AS b FROM
    (SELECT pair, s, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram FROM w, range(1, {orders} + 1) o(n)) GROUP BY ALL) GROUP BY ALL)"""


def _told(spark, d):
    own = read(spark, d, "conversations")
    asked = own.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    told = own.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("generated"))
    return asked.join(told, ["conv_id", "turn"]).select(F.concat("conv_id", F.lit(":"), "turn").alias("pair"), "reference", "generated")


@query(f"""WITH told AS ({_TOLD}), w AS ({_WORDS.format(split=r'[ \t\n\r\f\v]+')}), {_MATCHED.format(orders=4)},
  p AS (SELECT pair, coalesce(hits, 0) AS hits, coalesce(ours, 0) AS ours, coalesce(theirs, 0) AS theirs, n FROM (SELECT pair, n FROM told, range(1, 5) r(n)) LEFT JOIN m USING (pair, n)),
  s AS (SELECT pair, avg(ln((CASE WHEN hits = 0 THEN 0.1 ELSE hits END) / greatest(ours, 1))) AS mean, max(CASE WHEN n = 1 THEN hits END) AS hits, max(CASE WHEN n = 1 THEN ours END) AS ours, max(CASE WHEN n = 1 THEN theirs END) AS theirs FROM p GROUP BY pair)
  SELECT pair, CASE WHEN hits = 0 THEN 0 ELSE exp(mean) * CASE WHEN ours > theirs THEN 1 ELSE exp(1 - theirs / ours) END END AS bleu FROM s""")
def bleu_of_answers(spark, d):
    return N.bleu(_told(spark, d), "pair", "reference", "generated")


# the longest common subsequence by its table, a row at a time
@query(f"""WITH RECURSIVE told AS ({_TOLD}), w AS ({_WORDS.format(split='[^a-z0-9]+')}), {_MATCHED.format(orders=2)},
  t AS (SELECT x.pair, x.w AS a, y.w AS b FROM w x JOIN w y USING (pair) WHERE x.s = 0 AND y.s = 1),
  l AS (SELECT pair, a, b, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0) AS r FROM t
    UNION ALL SELECT pair, a, b, i + 1, list_concat([0], list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN b[k] = a[i + 1] THEN greatest(r[k] + 1, r[k + 1]) ELSE r[k + 1] END)))) FROM l WHERE i < len(a)),
  f AS (SELECT pair, n, CASE WHEN ours + theirs = 0 THEN 0 ELSE 2.0::DOUBLE * hits / (ours + theirs) END AS f FROM m)
  SELECT pair, coalesce((SELECT f FROM f WHERE f.pair = l.pair AND n = 1), 0) AS rouge1, coalesce((SELECT f FROM f WHERE f.pair = l.pair AND n = 2), 0) AS rouge2,
  CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE 2.0::DOUBLE * r[-1] / (len(a) + len(b)) END AS rougeL FROM l WHERE i = len(a)""")
def rouge_of_answers(spark, d):
    return N.rouge(_told(spark, d), "pair", "reference", "generated")


def part_texts(spark, d):
    """Names of parts with errors by their key, and the right names as templates."""
    whole = F.concat_ws(" ", "p_name", F.lower("p_type"), F.concat(F.lit("no. "), F.col("p_partkey") % 1000))
    wrong = F.when(F.col("p_partkey") % 4 == 1, F.regexp_replace(whole, "e", "3")).when(F.col("p_partkey") % 4 == 2, F.concat(F.substring(whole, 3, 1000), F.lit("?"))).when(F.col("p_partkey") % 4 == 3, F.concat_ws(" ", F.lower("p_type"), F.reverse("p_name"))).otherwise(whole)
    own = read(spark, d, "part").select("p_partkey", whole.alias("template"), wrong.alias("text"))
    return own.select("text"), own.select("p_partkey", "template").where("p_partkey % 4 <> 0 or p_partkey % 8 = 0")


@query()
def fuzzy_part_names(spark, d):
    texts, templates = part_texts(spark, d)
    return Z.closest_templates(texts, "text", templates, "template", "p_partkey", 0.8)


# embeddings as tiles of 8 by 8 grey values
_TILES = """SELECT vec_id, list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 1000) - 40) AS p FROM embeddings WHERE len(embedding) = 64"""


def tiles(spark, d):
    grey = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(F.abs(x) * 1000).cast("double") - 40)
    return read(spark, d, "embeddings").where(F.size("embedding") == 64).select("vec_id", grey.alias("p"))


@query(f"""WITH t AS ({_TILES}), a AS (SELECT vec_id, p, list_filter(p, lambda x: x > 10) AS a FROM t), x AS (SELECT vec_id, unnest(a) AS x FROM a),
  c AS (SELECT vec_id, bin, count(*) AS c FROM (SELECT vec_id, least(255, floor(x * 256 / 255)) AS bin FROM x WHERE x BETWEEN 0 AND 255) GROUP BY ALL), e AS (SELECT vec_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM c GROUP BY vec_id)
  SELECT vec_id, list_avg(a) AS mean, list_stddev_pop(a) AS std, len(list_filter(a, lambda x: x > 220)) / len(a) AS bright_frac, coalesce(entropy, 0) AS entropy, len(a) / 64 AS active_frac FROM a LEFT JOIN e USING (vec_id) WHERE len(a) > 0""")
def active_pixels(spark, d):
    return tiles(spark, d).select("vec_id", I.active_statistics(F.col("p")).alias("s")).where("s is not null").select("vec_id", "s.*")


@query(f"""WITH t AS ({_TILES}), x AS (SELECT vec_id, unnest(p) AS x, unnest(range(64)) AS i FROM t), b AS (SELECT vec_id, min(i // 8)::INTEGER AS top, max(i // 8)::INTEGER AS bottom, min(i % 8)::INTEGER AS "left", max(i % 8)::INTEGER AS "right" FROM x WHERE x > 150 GROUP BY vec_id),
  m AS (SELECT vec_id, avg(x) AS mean, avg((x >= 180)::INTEGER) AS bright_frac FROM x WHERE i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 2 AND 5 GROUP BY vec_id),
  k AS (SELECT vec_id, sum(x) AS kept, count(*) AS n FROM x LEFT JOIN b USING (vec_id) WHERE top IS NULL OR (i // 8 BETWEEN top AND bottom AND i % 8 BETWEEN "left" AND "right") GROUP BY vec_id)
  SELECT vec_id, top, bottom, "left", "right", coalesce(top, 8) AS dark_top, coalesce(7 - bottom, 8) AS dark_bottom, coalesce("left", 8) AS dark_left, coalesce(7 - "right", 8) AS dark_right, mean, bright_frac, kept, n::INTEGER AS n
  FROM t LEFT JOIN b USING (vec_id) LEFT JOIN m USING (vec_id) LEFT JOIN k USING (vec_id)""")
def borders_and_boxes(spark, d):
    p, w = F.col("p"), F.lit(8)
    told = tiles(spark, d).select("vec_id", I.bounding_box(p, w, 150).alias("b"), I.border_runs(p, w, 150).alias("r"), I.cropped_statistics(p, w, 0.3).alias("c"), I.trimmed(p, w, 150).alias("t"))
    kept = F.aggregate("t.pixels", F.lit(0.0), lambda s, x: s + x)
    edges = ("top", "bottom", "left", "right")
    return told.select("vec_id", *(F.col(f"b.{e}").cast("int").alias(e) for e in edges), *(F.col(f"r.{e}").alias(f"dark_{e}") for e in edges), "c.mean", "c.bright_frac", kept.alias("kept"), (F.col("t.width") * F.col("t.height")).alias("n"))


@query(f"""WITH t AS ({_TILES}), v AS (SELECT vec_id, list_transform(p, lambda x: x * 2 + 1) AS s, CASE WHEN vec_id % 3 = 0 THEN 150.0 ELSE 0.0 END AS width FROM t), e AS (SELECT *, CASE WHEN width > 0 THEN 100 - width / 2 ELSE list_min(s) END AS low, CASE WHEN width > 0 THEN 100 + width / 2 ELSE list_max(s) END AS high FROM v),
  o AS (SELECT vec_id, list_transform(s, lambda x: (least(greatest(x, low), high) - low) / (high - low)) AS o FROM e)
  SELECT vec_id, md5(array_to_string(list_transform(o, lambda x: floor(CASE WHEN vec_id % 2 = 0 THEN 1 - x ELSE x END * 255)::INTEGER), ',')) AS levels FROM o""")
def window_levels(spark, d):
    width = F.when(F.col("vec_id") % 3 == 0, 150.0).otherwise(0.0)
    levels = I.windowed(F.col("p"), F.lit(2.0), F.lit(1.0), F.lit(100.0), width, F.col("vec_id") % 2 == 0)
    return tiles(spark, d).select("vec_id", F.md5(F.array_join(levels.cast("array<string>"), ",")).alias("levels"))


@query("""WITH p AS (SELECT toxic, (doc_id % 2)::INTEGER AS even, (n_chars > 800)::INTEGER AS long FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL)
  SELECT count(*) AS n, count_if(even = toxic AND long <> toxic) AS up, count_if(even <> toxic AND long = toxic) AS down, avg((even = toxic)::INTEGER) AS first_accuracy, avg((long = toxic)::INTEGER) AS second_accuracy,
  true AS mean_near, true AS bounds_near FROM p""")
def bootstrap_bounds(spark, d):
    """The counts, and whether mean and bounds lie where those of so many resamples do (five standard errors)."""
    own = read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels").select("doc_id", "toxic"), "doc_id").where("toxic is not null")
    got = E.bootstrap_delta(own.select("toxic", (F.col("doc_id") % 2).cast("int").alias("even"), (F.col("n_chars") > 800).cast("int").alias("long")), "toxic", "even", "long")
    delta, sd = (F.col("up") - F.col("down")) / F.col("n"), F.sqrt((F.col("up") + F.col("down")) / F.col("n") - F.pow((F.col("up") - F.col("down")) / F.col("n"), F.lit(2.0))) / F.sqrt("n")
    near = lambda c, at, errors: F.abs(F.col(c) - at) <= errors * sd / F.sqrt(F.lit(2000.0)) + 1 / F.col("n")
    return got.select("n", "up", "down", "first_accuracy", "second_accuracy", near("mean_delta", delta, 5.0).alias("mean_near"), (near("low", delta - 1.96 * sd, 15.0) & near("high", delta + 1.96 * sd, 15.0)).alias("bounds_near"))


_HYP = "SELECT vec_id, label, embedding AS s, list_reverse(embedding) AS q, list_transform(embedding, lambda x, i: CASE WHEN i % 2 = 1 THEN x ELSE 0 END) AS y, list_transform(embedding, lambda x, i: CASE WHEN i % 2 = 1 THEN 0 ELSE x * abs(x) END) AS n FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings WHERE len(embedding) = 64)"


def hypotheses(spark, d):
    """Embeddings with a question and two hypotheses made of them."""
    own = read(spark, d, "embeddings").where(F.size("embedding") == 64).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("s"))
    return own.select("*", F.reverse("s").alias("q"), F.transform("s", lambda x, i: F.when(i % 2 == 0, x).otherwise(0.0)).alias("y"), F.transform("s", lambda x, i: F.when(i % 2 == 0, 0.0).otherwise(x * F.abs(x))).alias("n"))


@query(f"""WITH h AS ({_HYP}), f AS (SELECT vec_id, 'concat' AS mode, list_concat(s, q) AS x FROM h UNION ALL SELECT vec_id, 'interact', list_concat(list_concat(s, q), list_transform(list_zip(s, q), lambda p: p[1] * p[2])) FROM h
    UNION ALL SELECT vec_id, 'hyp', list_concat(list_concat(s, list_transform(list_zip(s, y), lambda p: p[1] * p[2])), list_concat(list_transform(list_zip(s, n), lambda p: p[1] * p[2]), [list_dot_product(s, y), list_dot_product(s, n), list_dot_product(s, y) - list_dot_product(s, n)])) FROM h
    UNION ALL SELECT vec_id, 'dmargin', [m - median(m) OVER (PARTITION BY label)] FROM (SELECT vec_id, label, list_dot_product(s, y) - list_dot_product(s, n) AS m FROM h))
  SELECT vec_id, mode, len(x)::INTEGER AS size, round(list_sum(x), 9) AS total, round(list_sum(list_transform(x, lambda v, i: v * i)), 7) AS placed FROM f""")
def probe_features(spark, d):
    own, (s, q, y, n) = hypotheses(spark, d), map(F.col, "sqyn")
    modes = F.array(*(F.struct(F.lit(m).alias("mode"), B.feature_mode(m, s, q, y, n).alias("x")) for m in ("concat", "interact", "hyp")))
    margin = B.margin_feature(own, "label", s, y, n, "x").select("vec_id", F.lit("dmargin").alias("mode"), "x")
    x = own.select("vec_id", F.inline(modes)).unionByName(margin)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
    return x.select("vec_id", "mode", F.size("x").alias("size"), F.round(total(F.col("x")), 9).alias("total"), F.round(total(F.transform("x", lambda v, i: v * (i + 1))), 7).alias("placed"))


@query()
def perceptron_probe(spark, d):
    """Toxic or not from embeddings of the same id: scaling, components and perceptron are fitted inside each of three folds."""
    x = B.feature_mode("interact", F.col("s"), F.col("q"), F.col("y"), F.col("n"))
    own = hypotheses(spark, d).select("vec_id", x.alias("x")).join(read(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), "toxic"), "vec_id")
    return B.fold_summary(B.out_of_fold(own.withColumn("g", F.col("vec_id") % 40), "x", "toxic", "g", 3, learner=B.perceptron(16)), "toxic")
