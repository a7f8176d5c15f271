"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are the context, and its text
alone is trained on. A conversation that does not end with an assistant turn gets one more example,
without loss, so that the output holds every turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rigtables.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    """No control string is left: a backslash is doubled, and `<|` gets one in its middle."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, lone, example, formatted, loss_start, loss_end) for turns (conv_id, turn, role, text).

    loss_start and loss_end are code points of `formatted` around the trained text; equal if none is.
    Null roles and texts are empty. Turns are ordered by turn (nulls first), then role, then text; repeated
    rows are turns like any other. A row without conv_id is a conversation of its own, told by `lone`. A line end in a role is
    escaped too. No rows give no examples; other columns are ignored. The examples of one conversation
    are as long as its prefixes together, as the method asks.
    """
    role = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\\n"))
    text = escaped(F.coalesce("text", F.lit("")))
    block = F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))
    plain = [F.coalesce(c, F.lit("")).alias(n) for c, n in (("role", "role"), ("text", "plain"))]
    one = F.struct("turn", *plain, text.alias("text"), block.alias("block"))
    named = turns.withColumn("lone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    chats = named.groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    trained = F.transform("turns", lambda t, i: F.struct((i + 1).alias("last"), (t["role"] == TRAINED).alias("trained")))
    wanted = F.filter(trained, lambda t: t["trained"] | (t["last"] == F.size("turns")))
    each = chats.select("conv_id", "lone", "turns", F.posexplode(wanted).alias("example", "at"))
    made = each.select(
        "conv_id",
        "lone",
        "example",
        F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("at.last")), lambda t: t["block"]), "").alias("formatted"),
        F.when(F.col("at.trained"), F.length(F.element_at("turns", F.col("at.last"))["text"])).otherwise(0).alias("n"),
    )
    end = F.length("formatted") - F.when(F.col("n") > 0, len(END) + 1).otherwise(0)
    return made.select("conv_id", "lone", "example", "formatted", (end - F.col("n")).cast("long").alias("loss_start"), end.cast("long").alias("loss_end"))


def read_chat(examples: DataFrame) -> DataFrame:
    """(conv_id, turns array of (role, text), loss_texts array, formatted_chars) from what format_chat() made."""
    start, length = (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")
    trained = F.substring("formatted", start, length)
    read = examples.groupBy("conv_id", "lone").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", trained.alias("text")))).alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    blocks = F.filter(F.split("whole", F.lit(r"<\|im_end\|>\n")), lambda b: F.startswith(b, F.lit(START)))
    parts = r"(?s)^<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*)$"
    turns = F.transform(blocks, lambda b: F.struct(unescaped(F.regexp_extract(b, parts, 1)).alias("role"), unescaped(F.regexp_extract(b, parts, 2)).alias("text")))
    return read.select("conv_id", turns.alias("turns"), F.transform("loss", lambda x: unescaped(x["text"])).alias("loss_texts"), "formatted_chars")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.lit(f"{END}{START}assistant ok")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), told.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("loss_texts", "")
    return read_chat(format_chat(turns)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
b AS (
  SELECT *, 24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10)))
    + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n FROM t),
r AS (
  SELECT *, sum(n) OVER w AS upto, lead(turn) OVER w IS NULL AS is_last
  FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR is_last THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
