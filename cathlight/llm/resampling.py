"""Target-distribution importance resampling with a dictionary of distinct features (operator 11).

Features are the runs of 1 to `n` consecutive words of a text (A-Z lower-cased, words of letters, digits and
all that is beyond ASCII), joined by one space. Their strings are counted over all documents and all target
texts; each distinct string is hashed once into one of `buckets` (CRC-32), and the buckets' counts give its
gain, the logarithm of how much likelier the target is to have it. Gains are joined back to the documents' own
feature counts: those of the KNOWN most frequent features by a broadcast table (of at most WIDE characters each, or
FAR for the few that are a 1024th of all), so that no string is a hot key, all others by their string, counted once a
document. A document's weight is
the floored mean of its gains; with a Gumbel term drawn from the hash of its id it becomes the score by which
the highest share of all documents with enough words is drawn, without replacement.

The draw is numbered by ranges of the score, so no window holds it in one place. Null and empty texts have no
feature and the weight 0. A null id counts as an empty one in the hash and comes last among ties. Repeated
rows are documents of their own. An empty target gives every feature the gain of an unseen one; empty
documents give an empty result. Columns of docs that clash with the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import Scratch, table

KNOWN, WIDE, FAR = 1 << 19, 64, 1 << 16
FEATURE_WORD, ANY_CASE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text as they stand; A-Z are lower-cased later, word by word."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(ANY_CASE), F.lit(0)), F.array().cast("array<string>"))


def lower(feature: Column) -> Column:
    """A-Z in lower case and nothing else; lower() does the same to plain ASCII, far faster."""
    return F.when(F.length(feature) == F.octet_length(feature), F.lower(feature)).otherwise(F.translate(feature, UPPER, LOWER))


def runs(found: Column, n: int) -> Column:
    """All runs of 1 to n of an array's words; found is a column, not an expression that every run would evaluate anew."""
    if n == 1:
        return found
    # slice() would read the whole array for every run
    of = lambda k: F.filter(F.transform(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.when(i + k <= F.size(found), F.concat_ws(" ", *(F.get(found, i + j) for j in range(k))))), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.concat(found, *(of(k) for k in range(2, n + 1)))).otherwise(found)


def dictionary(docs: DataFrame, target: DataFrame, n: int, buckets: int) -> DataFrame:
    """(feature, own, goal, bucket): every distinct feature, how often docs and the target (frames of a column text) have it, and its bucket."""
    # explode() would have Spark ask for the array's size below, and split every text once more; explode_outer() doesn't
    count = lambda df, c: df.select(words(F.col("text")).alias("w")).select(F.explode_outer(runs(F.col("w"), n)).alias("f")).where("f is not null").groupBy(lower(F.col("f")).alias("feature")).agg(F.count("*").alias(c))
    zero = F.lit(0).cast("long")
    both = count(docs, "own").withColumn("goal", zero).unionByName(count(target, "goal").withColumn("own", zero))
    return both.groupBy("feature").agg(F.sum("own").alias("own"), F.sum("goal").alias("goal")).withColumn("bucket", F.crc32("feature") % buckets)


def gains(strings: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of each bucket that any string has: at most `buckets` rows."""
    filled = strings.groupBy("bucket").agg(F.sum("own").alias("s"), F.sum("goal").alias("t"))
    total = filled.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("all_t"))
    likelier = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return filled.join(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(likelier)).cast("long").alias("gain"))  # one row


def gumbel(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) of a number u between 0 and 1 from the first 32 bits of sha256(`seed:key`)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def frequent(worth: DataFrame) -> DataFrame:
    """(feature, gain) of the most frequent features, at most KNOWN: those of the least count, to a sixteenth of a power of two, that no more reach."""
    step, room, least = F.floor(F.log2("own") * 16), KNOWN, None
    sizes = worth.groupBy(step.alias("x")).agg(F.count("*").alias("c"), F.sum("own").alias("n")).orderBy(F.desc("x")).collect()  # some hundred rows
    for r in sizes:
        room -= r.c
        if room < 0:
            break
        least = r.x
    total = sum(r.n for r in sizes)
    short = (F.length("feature") <= WIDE) & ((step >= least) if least is not None else F.lit(False))
    return worth.where(short | ((F.col("own") * 1024 >= total) & (F.length("feature") <= FAR))).select("feature", "gain")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, carry: list[str] | None = None) -> DataFrame:
    """docs (its columns in `carry`, by default all) with n_features, weight, score and rank: 1, 2, 3 ... for the drawn documents, null for the others."""
    added = ["n_features", "weight", "score", "rank"]
    scratch = Scratch(docs.sparkSession, "resample")
    carry = [c for c in (carry or docs.columns) if c not in added]
    text = F.col(text_col)
    strings = scratch.write(dictionary(docs.select(text.alias("text")), target.select(F.col(target_col).alias("text")), n, buckets))
    worth = scratch.write(strings.where("own > 0").join(F.broadcast(gains(strings, buckets)), "bucket").select("feature", "own", "gain"))
    # a row of each document for all its frequent features, and one for each other
    key = ["_i", "_h"]
    own = docs.select(F.col(id_col).alias("_i"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h"), words(text).alias("_w")).select(*key, F.size("_w").alias("_words"), runs(F.col("_w"), n).alias("_f")).withColumn("_n", F.size("_f"))
    each = own.select(*key, "_words", "_n", F.explode_outer("_f").alias("feature")).where("feature is not null").withColumn("feature", lower(F.col("feature")))
    met = each.join(F.broadcast(frequent(worth)), "feature", "left")
    counts = met.groupBy(*key, F.when(F.col("gain").isNull(), F.col("feature")).alias("feature")).agg(F.count("*").alias("c"), F.sum("gain").alias("g"), F.max("_words").alias("_words"), F.max("_n").alias("_n"))
    counts = scratch.write(counts)
    seldom = counts.where("feature is not null").drop("g").join(worth.select("feature", "gain"), "feature").withColumn("g", F.col("c") * F.col("gain"))
    parts = counts.where("feature is null").drop("feature").unionByName(seldom.drop("feature", "gain"))
    sums = parts.groupBy(*key).agg(F.sum("c").alias("c"), F.sum("g").alias("g"), F.max("_words").alias("_words"), F.max("_n").alias("_n"))
    same = F.col("l._i").eqNullSafe(F.col("r._i")) & (F.col("l._h") == F.col("r._h"))
    # rows that are repeated have added up, counts and gains alike: their mean is that of one
    mean = F.coalesce(F.expr("(r.g - pmod(r.g, r.c)) div r.c"), F.lit(0)).cast("long")
    keyed = docs.select(F.struct(*carry).alias("_own"), F.col(id_col).alias("_i"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h"))
    scored = keyed.alias("l").join(sums.alias("r"), same, "left").select("l.*", F.coalesce("r._n", F.lit(0)).cast("long").alias("n_features"), F.coalesce("r._words", F.lit(0)).alias("_words"), mean.alias("weight"))
    scored = scratch.write(scored.withColumn("score", F.col("weight") + gumbel(F.col("_i"), seed)).withColumn("_row", F.monotonically_increasing_id()))
    scratch.drop(strings, worth, counts)
    fit = scored.where(F.col("_words") >= least_words)
    most = fit.count() * percent // 100
    drawn = numbered(fit.select("_row", "_i", "score"), F.desc("score"), F.asc_nulls_last("_i"), name="rank").where(F.col("rank") <= most).select("_row", "rank")
    return scored.join(drawn, "_row", "left").select(*(F.col("_own")[c].alias(c) for c in carry), *added)


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("text"), carry=["doc_id"])


# The CRC-32 of a feature's bytes, byte by byte, from its table of 256 numbers
OP11_SQL = rf"""WITH x AS (SELECT list(list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crc FROM range(256) r(i)),
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{FEATURE_WORD}'), []) AS w FROM documents),
f AS (SELECT row, unnest(w) AS feature FROM d),
s AS (SELECT feature, count(*) AS s FROM f GROUP BY feature),
t AS (SELECT feature, count(*) AS t FROM (SELECT unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{FEATURE_WORD}')) AS feature FROM benchmark) GROUP BY feature),
b AS (SELECT feature, coalesce(s, 0) AS s, coalesce(t, 0) AS t, xor(list_reduce(list_transform(range(0, strlen(feature)), lambda i: ('0x' || substr(hex(encode(feature)), 2 * i + 1, 2))::BIGINT),
  lambda c, v: xor(crc[xor(c, v) % 256 + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket FROM s FULL JOIN t USING (feature), x),
g AS (SELECT bucket, floor(1000 * ln((sum(t) + 1)::DOUBLE * (sum(sum(s)) OVER () + 10000)::DOUBLE / ((sum(s) + 1)::DOUBLE * (sum(sum(t)) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM b GROUP BY bucket),
m AS (SELECT row, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN b USING (feature) JOIN g USING (bucket) GROUP BY row),
e AS (SELECT row, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m USING (row))
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= floor(count_if(n_features >= 20) OVER () / 10) THEN r END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r FROM e)"""
