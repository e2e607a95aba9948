"""URL verdicts from rules and empirical-Bayes host reputation (operator 10).

A labelled page's outcome is bad or not. Bad rates are shrunk down a chain of beta-binomial priors:
a suffix (last label) towards the rate of all pages, a registered domain (last two labels) towards
its suffix, a host towards its domain. The strength of each level's prior comes from the variance
between its groups (method of moments). A host is blocked if the lower bound of its posterior bad
rate is at least LIMIT. Rules, of which the longest that fits wins, come before the reputation.

Null urls and those without `://` have an empty host and path. Pages without a label count for
nothing and are judged like others. Rows are kept as they are, repeated ones too; each labelled row
is an outcome of its own. Columns of pages that clash with the added names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z, LIMIT = 1.645, 0.25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The rules of the query
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def reputation(hosts: DataFrame) -> DataFrame:
    """(host, bad_rate, bad_low) of the hosts in (host, bad), bad 0, 1 or null."""
    labels = F.split("host", r"\.")
    own = hosts.groupBy("host").agg(F.sum("bad").cast("double").alias("k"), F.count("bad").cast("double").alias("n"))
    own = own.select("host", F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), ".").alias("domain"), F.get(labels, F.size(labels) - 1).alias("suffix"), F.coalesce("k", F.lit(0.0)).alias("k"), "n")
    domains = own.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("k").alias("k"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))

    def strength(groups: DataFrame) -> DataFrame:
        """One row: m, the prior's weight in outcomes, and p, the rate of all."""
        some = groups.where("n > 0")
        sums = some.agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"), F.count("*").alias("g"))
        p = F.coalesce(F.try_divide("k", "n"), F.lit(0.0))
        between = F.col("kk") - F.col("k") * p
        rho = F.try_divide(between - p * (1 - p) * (F.col("g") - 1), p * (1 - p) * (F.col("n") - F.col("nn") / F.col("n") - F.col("g") + 1))
        rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.001)), F.lit(0.001)), F.lit(0.5))
        return sums.select(p.alias("p"), (1 / rho - 1).alias("m"))

    def shrunk(groups: DataFrame, prior: Column) -> Column:
        return (F.col("k") + F.col("m") * prior) / (F.col("n") + F.col("m"))

    one = F.broadcast  # each strength is a single row
    top = suffixes.join(one(strength(suffixes))).select("suffix", shrunk(suffixes, F.col("p")).alias("ps"))
    middle = domains.join(top, "suffix").join(one(strength(domains).select("m"))).select("domain", shrunk(domains, F.col("ps")).alias("pd"))
    low = own.join(middle, "domain").join(one(strength(own).select("m")))
    a, b = F.col("k") + F.col("m") * F.col("pd"), F.col("n") - F.col("k") + F.col("m") * (1 - F.col("pd"))
    return low.select("host", (a / (a + b)).alias("bad_rate"), (a / (a + b) - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("bad_low"))


def judge_urls(pages: DataFrame, url_col: str = "url", bad: Column | None = None, rules=RULES) -> DataFrame:
    """pages with host, path, rule, bad_rate, bad_low and verdict; bad is the outcome of a labelled row (0, 1, else null)."""
    added = ["host", "path", "rule", "bad_rate", "bad_low", "verdict"]
    host, path = split_url(F.col(url_col))
    own = pages.withColumn("_bad", bad if bad is not None else F.lit(None).cast("int")).drop(*added).withColumns({"host": host, "path": path})
    known = reputation(own.select("host", F.col("_bad").alias("bad")))
    name, verdict = rule_of(rules, F.col("host"), F.col("path"))
    told = own.drop("_bad").join(known, "host", "left")
    return told.withColumns({"rule": name, "verdict": F.coalesce(verdict, F.when(F.col("bad_low") >= LIMIT, "block").otherwise("allow"))})


def op10_url_reputation(spark, sf_dir: str) -> DataFrame:
    """The outcome of a page is the quality label of its id: 0 is bad."""
    from .common import table

    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("outcome"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    told = judge_urls(pages.join(labels, pages["page_id"] == labels["doc_id"], "left"), bad=F.col("outcome"))
    return told.select("page_id", "host", "path", "rule", "verdict")


def _level(table: str) -> str:
    return f"""SELECT p, 1 / least(greatest(coalesce(CASE WHEN p * (1 - p) * (n - nn / n - g + 1) <> 0 THEN (kk - k * p - p * (1 - p) * (g - 1)) / (p * (1 - p) * (n - nn / n - g + 1)) END, 0.001), 0.001), 0.5) - 1 AS m
  FROM (SELECT sum(k) AS k, sum(n) AS n, sum(n * n) AS nn, sum(k * k / n) AS kk, count(*)::DOUBLE AS g, coalesce(CASE WHEN sum(n) > 0 THEN sum(k) / sum(n) END, 0) AS p FROM {table} WHERE n > 0)"""


OP10_SQL = rf"""
WITH l AS (SELECT doc_id, max(1 - quality) AS outcome FROM labels GROUP BY doc_id),
u AS (
  SELECT page_id, outcome, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest
  FROM pages LEFT JOIN l ON page_id = doc_id
), h AS (
  SELECT page_id, outcome, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), own AS (
  SELECT host, split_part(host, '.', -1) AS suffix, CASE WHEN position('.' IN host) > 0 THEN split_part(host, '.', -2) || '.' || split_part(host, '.', -1) ELSE host END AS domain,
    coalesce(sum(outcome), 0)::DOUBLE AS k, count(outcome)::DOUBLE AS n FROM h GROUP BY host
), dom AS (SELECT domain, any_value(suffix) AS suffix, sum(k) AS k, sum(n) AS n FROM own GROUP BY domain),
suf AS (SELECT suffix, sum(k) AS k, sum(n) AS n FROM dom GROUP BY suffix),
ms AS ({_level("suf")}), md AS ({_level("dom")}), mh AS ({_level("own")}),
ps AS (SELECT suffix, (k + m * p) / (n + m) AS ps FROM suf, ms),
pd AS (SELECT domain, (k + m * ps) / (n + m) AS pd FROM dom JOIN ps USING (suffix), md),
ab AS (SELECT host, k + m * pd AS a, n - k + m * (1 - pd) AS b FROM own JOIN pd USING (domain), mh),
low AS (SELECT host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM ab)
SELECT page_id, host, path, r[1] AS rule, coalesce(r[2], CASE WHEN low >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM (
  SELECT page_id, host, path, low, CASE
    {" ".join(f"WHEN (host = '{a}' OR ends_with(host, '.{a}')) AND starts_with(path, '{b}') THEN ['{a}{b}', '{c}']" for a, b, c in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r)))}
    ELSE [NULL, NULL] END AS r
  FROM h JOIN low USING (host))
"""
