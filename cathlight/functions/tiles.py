"""Rules on images that are flat arrays of pixels, row by row: expressions over one row, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as black, and as bright
BLACK, BRIGHT = 10, 220


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def once(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def slot_entropy(slots: Column) -> Column:
    """Base-2 entropy of how often each number is in an array: log2(n) - sum(c log2 c) / n over its sorted runs."""
    part = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(0.0)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("c"), F.lit(0.0).alias("sum"))
    step = lambda s, x: F.when(s["last"] == x, F.struct(x.alias("last"), (s["c"] + 1).alias("c"), s["sum"].alias("sum"))).otherwise(F.struct(x.alias("last"), F.lit(1.0).alias("c"), (s["sum"] + part(s["c"])).alias("sum")))
    n = F.size(slots).cast("double")
    return F.when(n > 0, F.greatest(F.lit(0.0), F.log2(n) - F.aggregate(F.array_sort(slots), start, step, lambda s: s["sum"] + part(s["c"])) / n)).otherwise(0.0)


def active_statistics(pixels: Column, black: float = BLACK, bright: float = BRIGHT, bins: int = 256, top: float = 255.0) -> Column:
    """struct<mean, std, bright_frac, entropy, active_frac> over the pixels above `black`; null without any.

    std is the population's; entropy is that of a histogram of `bins` equal bins from 0 to `top` (the last one closed), in bits. A null pixel is not
    active, and counts in active_frac's base.
    """
    def told(active: Column) -> Column:
        n = F.size(active).cast("double")
        mean = _total(active) / n
        inside = F.filter(active, lambda x: (x >= 0) & (x <= top))
        slots = F.transform(inside, lambda x: F.least(F.lit(bins - 1), F.floor(x * bins / top)).cast("int"))
        spread = once(mean, lambda m: F.sqrt(F.aggregate(active, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / n))
        return F.when(n > 0, F.struct(mean.alias("mean"), spread.alias("std"), (F.size(F.filter(active, lambda x: x > bright)) / n).alias("bright_frac"), once(slots, slot_entropy).alias("entropy"), (n / F.size(pixels)).alias("active_frac")))

    return once(F.filter(pixels.cast("array<double>"), lambda x: x > black), told)


def inside_border(pixels: Column, width: Column, share: float) -> Column:
    """The pixels of an image of `width` columns without a border of that share of its rows and columns, one at least."""
    height = F.floor(F.size(pixels) / width)
    rows, columns = F.greatest(F.lit(1), F.floor(height * share)), F.greatest(F.lit(1), F.floor(width * share))
    return F.filter(pixels, lambda x, i: (i % width >= columns) & (i % width < width - columns) & (F.floor(i / width) >= rows) & (F.floor(i / width) < height - rows))


def cropped_statistics(pixels: Column, width: Column, share: float, bright: float = 180.0) -> Column:
    """struct<mean, bright_frac> of the pixels inside a border: their mean and the share of at least `bright`; null if the border leaves none."""
    return once(inside_border(pixels.cast("array<double>"), width, share), lambda x: F.when(F.size(x) > 0, F.struct((_total(x) / F.size(x)).alias("mean"), (F.size(F.filter(x, lambda p: p >= bright)) / F.size(x)).alias("bright_frac"))))


def bounding_box(pixels: Column, width: Column, threshold: float) -> Column:
    """struct<top, bottom, left, right>: first and last row and column with a pixel above the threshold; null if there is none."""
    lit_at = F.filter(F.transform(pixels, lambda x, i: F.when(x > threshold, i)), lambda i: i.isNotNull())
    def box(at: Column) -> Column:
        rows, columns = F.transform(at, lambda i: F.floor(i / width).cast("int")), F.transform(at, lambda i: i % width)
        return F.when(F.size(at) > 0, F.struct(F.array_min(rows).alias("top"), F.array_max(rows).alias("bottom"), F.array_min(columns).alias("left"), F.array_max(columns).alias("right")))

    return once(lit_at, box)


def trimmed(pixels: Column, width: Column, threshold: float) -> Column:
    """struct<width, height, pixels>: the image cut to its bounding box; without one, as it is."""
    def cut(b: Column) -> Column:
        kept = F.filter(pixels, lambda x, i: F.floor(i / width).between(b["top"], b["bottom"]) & (i % width).between(b["left"], b["right"]))
        whole = F.struct(width.cast("int").alias("width"), F.floor(F.size(pixels) / width).cast("int").alias("height"), pixels.alias("pixels"))
        return F.when(b.isNull(), whole).otherwise(F.struct((b["right"] - b["left"] + 1).cast("int").alias("width"), (b["bottom"] - b["top"] + 1).cast("int").alias("height"), kept.alias("pixels")))

    return once(bounding_box(pixels, width, threshold), cut)


def border_runs(pixels: Column, width: Column, threshold: float) -> Column:
    """struct<top, bottom, left, right>: how many whole rows and columns at each edge have no pixel above the threshold; all of them for a dark image."""
    height = F.floor(F.size(pixels) / width).cast("int")
    return once(bounding_box(pixels, width, threshold), lambda b: F.struct(
        F.coalesce(b["top"], height).alias("top"), F.coalesce(height - 1 - b["bottom"], height).alias("bottom"),
        F.coalesce(b["left"], width).cast("int").alias("left"), F.coalesce(width - 1 - b["right"], width).cast("int").alias("right"),
    ))


def windowed(pixels: Column, slope: Column, intercept: Column, center: Column, width: Column, invert: Column) -> Column:
    """Pixels as whole numbers from 0 to 255: rescaled, clipped to the window of a centre and a width above 0 or, without one, to the least and greatest value, and turned over where `invert` says.

    An image of one value, or a window that is empty, is all 0 (before it is turned over).
    """
    scaled = F.transform(pixels.cast("array<double>"), lambda x: x * F.coalesce(F.nullif(slope, F.lit(0.0)), F.lit(1.0)) + F.coalesce(intercept, F.lit(0.0)))

    def told(x: Column) -> Column:
        has = F.coalesce(width > 0, F.lit(False)) & center.isNotNull()
        ends = F.struct(F.when(has, center - width / 2.0).otherwise(F.array_min(x)).alias("low"), F.when(has, center + width / 2.0).otherwise(F.array_max(x)).alias("high"))

        def over(e: Column) -> Column:
            share = lambda v: F.when(e["high"] > e["low"], (F.least(F.greatest(v, e["low"]), e["high"]) - e["low"]) / (e["high"] - e["low"])).otherwise(0.0)
            return F.transform(x, lambda v: F.floor(F.when(F.coalesce(invert, F.lit(False)), 1 - share(v)).otherwise(share(v)) * 255).cast("int"))

        return once(ends, over)

    return once(scaled, told)
