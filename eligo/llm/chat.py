"""Chat formatting with Spark expressions only: turns are collected as structs and sorted, adjacent turns of one role
share a header, and the pieces are concatenated with a loss mask over what the assistant says.

    ### user: first text</part>second text</turn>
    ### assistant: answer</turn>

Control strings inside roles and texts are escaped with a backslash and a letter, so that an escaped text holds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD, NAMED, PART, TURN = "### ", ": ", "</part>", "</turn>"
#: Fixed values of the format, in the order of escaping; unescaping goes backwards.
ESCAPES = (("\\", "\\s"), ("###", "\\h"), ("</part>", "\\p"), ("</turn>", "\\t"))
BLOCK = 64  # lengths are summed by blocks first, so long conversations don't cost the square of their turns


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\c"), F.lit(":"))
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _sum(lengths: Column, start: Column, n: Column) -> Column:
    return F.aggregate(F.slice(lengths, start, n), F.lit(0).cast("long"), lambda a, x: a + x)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, n_blocks, formatted, loss_spans) for each conversation.

    Turns sort by turn, then role, then text; a null turn sorts first, null roles and texts are empty, repeated rows are
    turns of their own, and a null id is one conversation. loss_spans has (start, chars) in code points of `formatted`
    for each text of `learn_role`, in order; headers and marks are never under the mask.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def piece(x, i):
        opens = (i == 0) | (F.get(F.col("t"), i - 1)["role"] != x["role"])
        closes = (i == F.size("t") - 1) | (F.get(F.col("t"), i + 1)["role"] != x["role"])
        return F.struct(
            F.when(opens, F.concat(F.lit(HEAD), escape_role(x["role"]), F.lit(NAMED))).otherwise(F.lit(PART)).alias("before"),
            escape(x["text"]).alias("text"),
            F.when(closes, F.lit(TURN + "\n")).otherwise(F.lit("")).alias("after"),
            opens.alias("opens"),
            (x["role"] == F.lit(learn_role)).alias("learn"),
        )

    pieces = sorted_turns.select("conv_id", F.transform("t", piece).alias("p"))
    sized = pieces.select("*", F.transform("p", lambda x: (F.length(x["before"]) + F.length(x["text"]) + F.length(x["after"])).cast("long")).alias("n"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("n") - 1) / BLOCK).cast("int")), lambda b: _sum(F.col("n"), b * BLOCK + 1, F.lit(BLOCK)))
    placed = sized.select("*", blocks.alias("blocks"))

    def span(x, i):
        block = F.floor(i / BLOCK).cast("int")
        start = _sum(F.col("blocks"), F.lit(1), block) + _sum(F.col("n"), block * BLOCK + 1, i - block * BLOCK) + F.length(x["before"])
        return F.struct(start.alias("start"), F.length(x["text"]).cast("long").alias("chars"), x["learn"].alias("learn"))

    spans = F.transform(F.filter(F.transform("p", span), lambda s: s["learn"]), lambda s: F.struct(s["start"].alias("start"), s["chars"].alias("chars")))
    return placed.select(
        "conv_id",
        F.size("p").cast("long").alias("n_turns"),
        F.size(F.filter("p", lambda x: x["opens"])).cast("long").alias("n_blocks"),
        F.array_join(F.transform("p", lambda x: F.concat(x["before"], x["text"], x["after"])), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_conversations(formatted: DataFrame) -> DataFrame:
    """The turns (role, text) and the text under the mask, read back from format_conversations' output."""
    blocks = F.filter(F.split(F.col("formatted"), F.lit(TURN + "\n")), lambda b: b != "")
    parted = F.transform(blocks, lambda b: F.struct(F.substring_index(F.substr(b, F.lit(len(HEAD) + 1)), NAMED, 1).alias("role"), b.alias("block")))
    turns = F.flatten(
        F.transform(
            parted,
            lambda b: F.transform(
                F.split(F.substr(b["block"], F.length(b["role"]) + F.lit(len(HEAD) + len(NAMED) + 1)), F.lit(PART)),
                lambda t: F.struct(unescape(b["role"]).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    learned = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["chars"].cast("int")))), "")
    return formatted.select("*", turns.alias("turns"), learned.alias("loss_text"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    back = read_conversations(format_conversations(rows.unionByName(added)))
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said_all.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: From the table itself, without a template; formatted_chars by counting what the template adds.
OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w IS DISTINCT FROM role AS opens,
    length(replace(replace(replace(replace(text, '\', '\s'), '###', '\h'), '</part>', '\p'), '</turn>', '\t')) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN opens THEN 6 + length(role) + 8 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
