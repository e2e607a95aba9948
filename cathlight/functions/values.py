"""Dates, times, numbers and nested values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip


def number(c: Column) -> Column:
    """Text as a number; what isn't one is null."""
    return F.nullif(strip(c.cast("string")), F.lit("")).try_cast("double")


def whole(c: Column) -> Column:
    return number(c).try_cast("bigint")


def date_key(c: Column) -> Column:
    """yyyymmdd as a number: eight digits with a month and day in range (no calendar check), or an ISO date."""
    t = strip(c)
    month, day = F.substring(t, 5, 2).try_cast("int"), F.substring(t, 7, 2).try_cast("int")
    eight = F.when(month.between(1, 12) & day.between(1, 31), t.try_cast("bigint"))
    return F.when(t.rlike(r"^\d{8}$"), eight).otherwise(F.date_format(F.try_to_date(t), "yyyyMMdd").try_cast("bigint"))


def time_key(c: Column) -> Column:
    """Microseconds of the day from HH, HHMM or HHMMSS with an optional fraction, colons allowed."""
    t = F.replace(strip(c), F.lit(":"), F.lit(""))
    digits, fraction = F.regexp_extract(t, r"^(\d{2}|\d{4}|\d{6})(?:\.(\d{1,6}))?$", 1), F.regexp_extract(t, r"^\d{6}\.(\d{1,6})$", 1)
    part = lambda a: F.coalesce(F.substring(digits, a, 2).try_cast("bigint"), F.lit(0))
    h, m, s = part(1), part(3), part(5)
    micro = F.coalesce(F.rpad(fraction, 6, "0").try_cast("bigint"), F.lit(0))
    return F.when((digits != "") & (h < 24) & (m < 60) & (s < 60), ((h * 60 + m) * 60 + s) * 1_000_000 + micro)


def share(c: Column) -> Column:
    """Ratios as percent, within 0 and 100."""
    return F.least(F.greatest(F.when(c <= 1, c * 100).otherwise(c), F.lit(0.0)), F.lit(100.0))


def index0(c: Column) -> Column:
    """A 1-based index in text as a 0-based one, -1 if there is none."""
    x = number(c)
    return F.when(x >= 1, F.floor(x).cast("bigint") - 1).otherwise(F.lit(-1))


def uniform_indices(n: Column, k: int, rounded: bool = True) -> Column:
    """k indices spread over 0 to n - 1, without repeats; the middle one for k = 1."""
    if k == 1:
        return F.array((n.cast("int") / 2).cast("int"))
    at = lambda i: i * (n - 1) / F.lit(float(k - 1))
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.bround(at(i)) if rounded else F.floor(at(i))).cast("int"))
    return F.when(n <= k, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array_distinct(spread))


def grid(n: Column, most: int = 6) -> Column:
    """Columns and rows of a near-square mosaic."""
    columns = F.least(F.lit(most), F.ceil(F.sqrt(n)).cast("int"))
    return F.struct(columns.alias("columns"), F.ceil(n / columns).cast("int").alias("rows"))


def listed(c: Column) -> Column:
    """A JSON array, or comma text, as an array."""
    return F.coalesce(F.from_json(c, "array<string>"), F.transform(F.split(c, ","), strip))


def year_of(c: Column) -> Column:
    return F.substring(c.cast("string"), 1, 4)


def years_in(c: Column, first: int = 1990, last: int = 2035) -> Column:
    """Plausible years in a text, in order."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"\b((?:19|20)\d{2})\b"), 1), lambda y: y.cast("int")), lambda y: y.between(first, last))


def list_hash(c: Column, size: int = 8) -> Column:
    """A short stable hash of a list of texts."""
    return F.substring(F.sha1(F.array_join(c, "|")), 1, size)


def institution(c: Column, own: str) -> Column:
    return F.when(F.lower(strip(c)) == own, F.upper(F.lit(own))).otherwise(F.lit(f"Non-{own.upper()}"))


def min_max(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with `scaled`, the value between its group's least (0) and greatest (1); 0 in a constant group."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    v, lo, hi = F.col(value), F.col("_lo"), F.col("_hi")
    return df.join(ends, by).withColumn("scaled", F.when(hi == lo, 0.0).otherwise((v - lo) / (hi - lo))).drop("_lo", "_hi")


def entropy_by(df: DataFrame, by: list[str], value: str, low: int, high: int) -> DataFrame:
    """Base-2 entropy of each group's histogram, one bin for each whole number from low to high; other values are left out."""
    v = F.col(value)
    bins = df.where(v.between(low, high)).groupBy(*by, F.least(F.lit(high), F.floor(v)).alias("_bin")).agg(F.count("*").alias("c"))
    # -sum(c/n log2(c/n)) = log2(n) - sum(c log2 c) / n
    return bins.groupBy(*by).agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"))


def path_or(c: Column, path: str, default: str | None = None) -> Column:
    """The text at a JSON path, else the default."""
    return F.coalesce(F.get_json_object(c, path), F.lit(default).cast("string"))


def first_filled(columns: list[Column], otherwise: Column) -> Column:
    """The first text that isn't blank, trimmed."""
    return F.coalesce(*(F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit("")) for c in columns), otherwise)


def zulu(c: Column) -> Column:
    """An ISO timestamp with an offset or Z; what isn't one is null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\S+$"), F.try_to_timestamp(c))
