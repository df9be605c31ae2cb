"""Chat logs that hold the same conversation again after every turn, collapsed to the longest and rendered.

Every turn gets a rolling hash of the conversation up to it: the sum of two 64-bit hashes of its place, role and text over
all turns so far. Sums can be taken in blocks, so one very long conversation is not one task. A conversation
whose hash after its last turn is the hash of another one before its last turn is a prefix of that one; an anti-join
removes it. Of equal conversations the one with the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import dense_index, running
from .common import landed, read

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, h1, h2): the rolling hashes after every turn, as a landed table; ``turns`` has no repeated rows."""
    hashed = turns.select("conv_id", "turn", "role", "text", F.xxhash64(F.lit(1), "role", "text").alias("one"), F.xxhash64(F.lit(2), "role", "text").alias("two"))
    placed = dense_index(hashed, ["turn", "role", "text"], out="place", keys=["conv_id"]).drop("role", "text")
    value = lambda salt: F.xxhash64(F.lit(salt), "place", "one", "two").cast("decimal(20,0)")
    return landed(running(placed, ["conv_id"], "place", {"h1": value(3), "h2": value(4)}, inclusive=True).select("conv_id", "place", "h1", "h2"), "prefixes")


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no prefix of a longer one."""
    rolling = prefixes(turns)
    state = ("place", "h1", "h2")
    ends = landed(rolling.groupBy("conv_id").agg(F.max(F.struct(*state)).alias("end")).select("conv_id", "end.*"), "conversation-ends")
    last = ends.select("conv_id", F.col("place").alias("last"))
    before = landed(rolling.join(last, "conv_id").filter("place < last").select(*state).distinct(), "snapshots")
    alike = landed(ends.groupBy(*state).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies")), "conversations")
    return alike.join(before, list(state), "left_anti").select("conv_id", (F.col("place") + 1).alias("n_turns"), "n_copies")


def rendered(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies (equal ones, itself included), chat (its text).

    Turns are ordered by number (null first), then role and text; rows repeated within a conversation count once, and null roles and
    texts are empty. Rows without a conv_id belong to no conversation and are left out. Other columns are not read.
    """
    empty = F.lit("")
    turns = conversations.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).distinct()
    kept = landed(maximal(turns), "maximal")
    lines = turns.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    line = lambda turn: F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE + "\n"))
    return lines.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", line), "").alias("chat"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(read(spark, sf_dir, "conversations"))


OP5_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT conv_id, place, n, md5(string_agg(role || chr(1) || text || chr(2), '') OVER (PARTITION BY conv_id ORDER BY place)) AS h,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY place) AS chat FROM r
), g AS (SELECT h, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE place = n GROUP BY h)
SELECT p.conv_id, p.n AS n_turns, g.n_copies, p.chat FROM p JOIN g ON g.conv_id = p.conv_id AND p.place = p.n
WHERE p.h NOT IN (SELECT h FROM p WHERE place < n)
"""
