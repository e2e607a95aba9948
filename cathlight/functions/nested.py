"""JSON text as columns: leaves, boolean paths, lists under unknown keys, objects inside other text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import strip

# A token of JSON without white space: a string (a key keeps its colon), an empty list, a number or a literal
TOKEN = r'"(?:[^"\\]++|\\.)*+":?|\[\]|-?\d[\d.eE+-]*|true|false|null'
# Leaves that say nothing, labels that mean "something else"
EMPTY = ['null', '[]', '"other"', '"unknown"']
OTHERS = ["other", "others", "other (please specify)", "other (specify)", "something else"]


def variant(c: Column) -> Column:
    return F.try_parse_json(c)


def kind(v: Column) -> Column:
    """object, list or other of a variant; null for none."""
    schema = F.schema_of_variant(v)
    return F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "list").when(schema.isNotNull(), "other")


def leaf_counts(c: Column) -> Column:
    """struct<total, empty> of the leaves of JSON text; an empty list is one empty leaf, an empty object none. Null for what isn't JSON."""
    tokens = F.regexp_extract_all(F.to_json(variant(c)), F.lit(TOKEN), F.lit(0))
    leaves = F.filter(tokens, lambda t: ~t.endswith('":'))
    return F.when(variant(c).isNotNull(), F.struct(F.size(leaves).alias("total"), F.size(F.filter(leaves, lambda t: t.isin(EMPTY))).alias("empty")))


def field(c: Column, path: str, type_: str = "string") -> Column:
    """The value at a path of JSON text; null where the path, or JSON, isn't there."""
    return F.try_variant_get(variant(c), path, type_)


def _untitled(c: Column) -> Column:
    return (F.lower(strip(F.coalesce(field(c, "$.title"), F.lit("")))) == "untitled") & field(c, "$.year").isNull()


def _hollow(c: Column, share: float) -> Column:
    n = leaf_counts(c)
    return F.coalesce((n["total"] > 0) & (n["empty"] / n["total"] >= share), F.lit(False))


def degenerate(c: Column, share: float = 0.8) -> Column:
    """A record without title and year most of whose leaves are empty."""
    return variant(c).isNotNull() & _untitled(c) & _hollow(c, share)


def checklist_degenerate(c: Column, block: str = "adherence", share: float = 0.8) -> Column:
    """A record without title and year whose checklist says no to every item, or most of whose leaves are empty."""
    items = F.from_json(field(c, f"$.{block}"), "map<string,struct<adherence:string>>")
    said = F.filter(F.map_values(items), lambda v: v.isNotNull())
    all_no = F.coalesce((F.size(items) > 0) & F.forall(said, lambda v: F.upper(strip(F.coalesce(v["adherence"], F.lit("")))) == "NO"), F.lit(False))
    return variant(c).isNotNull() & _untitled(c) & (all_no | _hollow(c, share))


def _booleans(value, path: str, out: dict) -> dict:
    if isinstance(value, dict):
        for k, v in value.items():
            _booleans(v, f"{path}.{k}" if path else k, out)
    elif isinstance(value, bool):
        out[path] = value
    return out


@F.pandas_udf(StringType())
def _boolean_text(texts: pd.Series) -> pd.Series:
    def flat(t):
        try:
            return json.dumps(_booleans(json.loads(t), "", {}))
        except (TypeError, ValueError, RecursionError):
            return None

    return texts.map(flat)


def boolean_paths(c: Column) -> Column:
    """map<dotted path, boolean> of JSON text of any depth; lists are passed over, what isn't JSON is null."""
    return F.from_json(_boolean_text(c), "map<string,boolean>")


def lenient_object(c: Column) -> Column:
    """The JSON object that a text is, or the one from its first { to its last }; JSON of another kind is null."""
    inner = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    text = F.when(variant(c).isNotNull(), c).otherwise(inner)
    return F.when(kind(variant(text)) == "object", text)


def options(c: Column, most: int = 4) -> Column:
    """Labels of a list without bullets, blanks, repeats and words for "other"; the first `most`."""
    bare = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: strip(F.regexp_replace(strip(F.coalesce(x, F.lit(""))), "^[-•]+|[-•]+$", "")))
    return F.slice(F.array_distinct(F.filter(bare, lambda x: (x != "") & ~F.lower(x).isin(OTHERS))), 1, most)


def has_list(c: Column, key: str = "sequences") -> Column:
    """Whether a text is a JSON object with a list under the key."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(variant(c), f"$.{key}", "variant")).startswith("ARRAY"), F.lit(False))


def found_list(c: Column, keys: list[str]) -> Column:
    """struct<path, items>: the first list of objects or of strings in JSON text: the root, else one of the keys in order, else any other key by name."""
    root = variant(c)
    listed = lambda v: F.schema_of_variant(v).rlike("^ARRAY<(?:OBJECT|STRING)")
    out = F.when(listed(root), F.struct(F.lit("$").alias("path"), F.try_variant_get(root, "$", "array<string>").alias("items")))
    for key in keys:
        own = F.try_variant_get(root, f"$.{key}", "variant")
        out = out.when(listed(own), F.struct(F.lit(f"$.{key}").alias("path"), F.try_variant_get(own, "$", "array<string>").alias("items")))
    rest = F.filter(F.map_entries(F.try_variant_get(root, "$", "map<string,variant>")), lambda e: listed(e["value"]))
    first = F.get(F.array_sort(F.transform(rest, lambda e: F.struct(F.concat(F.lit("$."), e["key"]).alias("path"), F.try_variant_get(e["value"], "$", "array<string>").alias("items")))), F.lit(0))
    return out.otherwise(first)


def config_hash(*settings: tuple[str, Column]) -> Column:
    """Eight hex digits of named settings, in the order of their names."""
    named = F.struct(*(c.cast("string").alias(n) for n, c in sorted(settings, key=lambda s: s[0])))
    return F.substring(F.sha1(F.to_json(named, {"ignoreNullFields": "false"})), 1, 8)
