"""Chat formatting: logged snapshots of a growing conversation collapse to the longest one, which is rendered.

A service that logs the whole conversation after each turn stores many prefixes of the same exchange. Each turn
gets a rolling hash of the turns up to it; a conversation whose full hash occurs as the hash of a strict prefix
of another one is dropped by an anti-join, and of equal conversations the one with the smallest id stays.
Everything is made of built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

OPEN, BETWEEN, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 1), role, text and the hash pair (h1, h2) of all turns up to the position."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn_hash = lambda seed: F.xxhash64(F.lit(seed), "position", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    numbered = turns.select("conv_id", "turn", "role", "text").withColumn("position", F.row_number().over(order))
    return numbered.select(
        "conv_id", "position", "role", "text",
        F.bit_xor(turn_hash(1)).over(so_far).alias("h1"), F.bit_xor(turn_hash(2)).over(so_far).alias("h2"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation that no other one continues: conv_id, n_turns, n_copies (conversations with
    just these turns), turns (array of role and text in order).

    Turns are ordered by turn, ties by role and text, nulls first; a null role or text is a value of its own;
    rows with a null conv_id form one conversation. A repeated row is a turn that occurs twice. Of equal
    conversations the smallest conv_id stays (null before any)."""
    prefixes = turn_prefixes(turns)
    whole = prefixes.groupBy("conv_id").agg(
        F.max("position").alias("n_turns"), F.max_by("h1", "position").alias("h1"), F.max_by("h2", "position").alias("h2"),
        F.array_sort(F.collect_list(F.struct("position", "role", "text"))).alias("turns"),
    )
    # Inner prefixes: all but the last. Equal ones are merged before they move, so a common first turn is one row.
    last = Window.partitionBy("conv_id")
    inner = prefixes.withColumn("n", F.max("position").over(last)).filter("position < n").groupBy("position", "h1", "h2").agg(F.count("*").alias("_"))
    key = ["n_turns", "h1", "h2"]
    kept = whole.groupBy(*key).agg(F.count("*").alias("n_copies"), F.min(F.struct("conv_id", "turns")).alias("first"))
    kept = kept.join(inner.select(F.col("position").alias("n_turns"), "h1", "h2"), key, "left_anti")
    return kept.select("first.conv_id", "n_turns", "n_copies", F.expr("transform(first.turns, t -> struct(t.role, t.text))").alias("turns"))


def render(conversations: DataFrame) -> DataFrame:
    """Adds the column chat: each turn as <|im_start|>role newline text<|im_end|> newline (nulls as empty)."""
    one = F.transform("turns", lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(BETWEEN), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE)))
    return conversations.withColumn("chat", F.array_join(one, ""))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(maximal_conversations(read(spark, sf_dir, "conversations"))).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", "chat")


QUERIES = {"op2_chat_formatting": op2_chat_formatting}
SQL = {
    "op2_chat_formatting": """
WITH turns AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position FROM conversations),
prefixes AS (SELECT conv_id, position, max(position) OVER (PARTITION BY conv_id) AS n_turns,
 list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY position) AS so_far FROM turns),
whole AS (SELECT conv_id, n_turns, so_far FROM prefixes WHERE position = n_turns),
kept AS (SELECT n_turns, so_far, count(*) AS n_copies, min(conv_id) AS conv_id FROM whole
 WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.position < p.n_turns AND p.position = whole.n_turns AND p.so_far = whole.so_far) GROUP BY n_turns, so_far)
SELECT conv_id, n_turns, n_copies, array_to_string(list_transform(so_far, lambda t: '<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10)), '') AS chat FROM kept
"""
}
