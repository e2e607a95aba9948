"""Chat formatting with Spark expressions only (operator 3).

A conversation's rows are collected and sorted by turn (ties by role, then text), adjacent turns of
one role are merged into a block, and blocks are concatenated:

    <|turn|>ROLE<|text|>TEXT<|next|>TEXT<|end|>

A backslash after the first character of any control string inside a role or text, after such
backslashes as stand there already, keeps it from being read as one; read_back() takes it out again.
Segments hold the same string cut where the loss mask changes: the mask covers assistant texts alone.

Null roles and texts are empty. Null turns come first. Rows with a null id form one conversation.
Repeated rows are turns of their own. Other columns are not part of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's own marks, and other templates' control strings
TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
CONTROL = r"\||/?s>|</?SYS>>|/?INST\]"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def _quote(mark: str) -> str:
    return mark.replace("|", r"\|")


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: str = "assistant") -> DataFrame:
    """(id, formatted, segments array<struct<text, loss>>); segments joined are formatted."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sorted_ = rows.select(F.col(id_col).alias("_id"), turn.alias("t")).groupBy("_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    starts = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"]))
    begun = sorted_.withColumn("starts", starts)
    blocks = F.transform("starts", lambda s, k: F.slice("turns", s, F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - s))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def lay(block: Column) -> Column:
        role = F.get(block, F.lit(0))["role"]
        head = F.array(part(F.concat(F.lit(TURN), escape(role), F.lit(TEXT)), no))
        body = F.flatten(F.transform(block, lambda t, k: F.when(k > 0, F.array(part(F.lit(NEXT), no), part(escape(t["text"]), role == learned))).otherwise(F.array(part(escape(t["text"]), role == learned)))))
        return F.concat(head, body, F.array(part(F.lit(END), no)))

    laid = begun.withColumn("blocks", blocks).select("_id", F.flatten(F.transform("blocks", lay)).alias("segments"))
    return laid.select(F.col("_id").alias(id_col), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns array<struct<role, text>>, learned, formatted): turns parsed from formatted, learned is all text under the mask."""
    blocks = F.filter(F.split("formatted", _quote(TURN)), lambda b: b != "")

    def turns(block: Column) -> Column:
        halves = F.split(F.substring(block, F.lit(1), F.length(block) - len(END)), _quote(TEXT), 2)
        return F.transform(F.split(F.get(halves, F.lit(1)), _quote(NEXT), -1), lambda t: F.struct(unescape(F.get(halves, F.lit(0))).alias("role"), unescape(t).alias("text")))

    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return chats.select(id_col, F.flatten(F.transform(blocks, turns)).alias("turns"), learned.alias("learned"), "formatted")


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    back = read_back(format_chats(rows.unionByName(probe)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), told AS (
  SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS fresh,
    length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g')) AS n,
    length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g')) AS r
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(n) + sum(CASE WHEN fresh = 1 THEN 8 + r + 8 + 7 ELSE 8 END))::BIGINT AS formatted_chars
FROM told GROUP BY conv_id
"""
