r"""Chat formatting with Column expressions only.

The turns of a conversation are collected as structs and sorted; neighbours of the same role are merged
into one block by array functions; blocks are concatenated to a text:

    ### role: first part</part>second part</turn>\\n

Control strings cannot occur inside: in roles and texts every ``\\`` becomes ``\\b``, ``<`` becomes ``\\l``
and ``#`` becomes ``\\h``, so ``</turn>``, ``</part>`` and ``### `` are always the template's own. The
way back (``read_back``) is exact. ``loss`` lists (start, length) of every assistant part inside the
formatted text, in code points: the tokens a model learns from.

Turns are sorted by turn, then role, then text; null turns come first. Null texts and null roles count as
empty; repeated rows are turns of their own. Rows without a conv_id form one conversation of their
own. Other columns are left aside. Empty tables give empty results. A conversation is one row, so it has
to fit into one task; conversations themselves spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.llm.common import query, table

HEAD, COLON, PART, TURN = "### ", ": ", "</part>", "</turn>\n"
#: A conversation that holds the template's own control strings.
PROBE = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def escape(text: Column) -> Column:
    for plain, coded in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in (("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, blocks, formatted, loss) of every conversation in rows (conv_id, turn, role, text)."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    at = F.sequence(F.lit(0), F.size("_turns") - 1)
    first = F.filter(at, lambda i: (i == 0) | (F.get("_turns", i)["role"] != F.get("_turns", i - 1)["role"]))
    merged = sorted_turns.withColumn("_first", first).withColumn("blocks", F.transform("_first", lambda s, k: F.struct(
        F.get("_turns", s)["role"].alias("role"),
        F.transform(F.slice("_turns", s + 1, F.coalesce(F.get("_first", k + 1), F.size("_turns")) - s),
                    lambda t: t["text"]).alias("parts"))))
    laid = merged.withColumn("_pieces", F.flatten(F.transform("blocks", lambda b: F.transform(b["parts"], lambda p, k: F.struct(
        F.when(k == 0, F.concat(F.lit(HEAD), escape_role(b["role"]), F.lit(COLON))).otherwise(F.lit("")).alias("head"),
        escape(p).alias("body"),
        F.when(k == F.size(b["parts"]) - 1, F.lit(TURN)).otherwise(F.lit(PART)).alias("tail"),
        (b["role"] == "assistant").alias("learned"))))))
    zero = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        head, body, tail = (F.length(p[c]).cast("long") for c in ("head", "body", "tail"))
        span = F.struct((acc["at"] + head).alias("start"), body.alias("length"))
        return F.struct((acc["at"] + head + body + tail).alias("at"),
                        F.when(p["learned"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return laid.select(
        "conv_id", "blocks",
        F.concat_ws("", F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], p["tail"]))).alias("formatted"),
        F.aggregate("_pieces", zero, add, lambda acc: acc["spans"]).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    texts = F.split(formatted, TURN)
    blocks = F.slice(texts, 1, F.size(texts) - 1)

    def turns(block: Column) -> Column:
        head = F.split(block, COLON, 2)
        role = unescape_role(F.substring(F.get(head, F.lit(0)), len(HEAD) + 1, 1 << 30))
        return F.transform(F.split(F.get(head, F.lit(1)), PART), lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"].cast("int"), s["length"].cast("int")))))


_ESC = r"replace(replace(replace({}, '\', '\b'), '<', '\l'), '#', '\h')"
OP5_SQL = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before, lead(role) OVER w AS after
    FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, length({_ESC.format('text')})
    + CASE WHEN before IS DISTINCT FROM role THEN 4 + length(replace({_ESC.format('role')}, ':', '\c')) + 2 ELSE 0 END
    + CASE WHEN after IS DISTINCT FROM role THEN 8 ELSE 7 END AS size FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
    sum(size)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id"""


@query("op5_chat_format", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    probe = spark.sql("SELECT * FROM VALUES " + ", ".join(
        f"({c}L, {t}L, '{r}', r'{x}')" for c, t, r, x in PROBE) + " AS p(conv_id, turn, role, text)")
    out = format_chats(rows.unionByName(probe)).withColumn("_turns", read_back(F.col("formatted")))         .withColumn("_learned", learned_text(F.col("formatted"), F.col("loss")))
    lines = F.concat_ws("", F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("_learned").cast("long").alias("loss_chars"), F.sha2(F.col("_learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
