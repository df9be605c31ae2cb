"""Exact duplicates by merging sorted runs of digests in a tree.

Every row starts in one of ``leaves`` blocks. A block's run holds one entry per digest: the identifier that
stays and the number of copies. In each round ``fan_in`` neighbouring blocks exchange and merge their runs,
so an entry meets at most ``fan_in`` others, however many copies it stands for; after the last round each
digest has one entry. The answers then go back down the same tree, again to at most ``fan_in`` entries each.

Merging is verified: entries meet on the SHA-256 digest, the length in bytes and a hash of another family.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import NO_ID, doc_id, landed, lowered, read

FAN_IN = 8
LEAVES = 512
SAME = ("text_sha256", "n_bytes", "check")


def digests(docs: DataFrame) -> DataFrame:
    """(key, digest columns) of every row; null text counts as empty."""
    text = lowered(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("key"), text.alias("_text"),
    ).select(
        "key", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"), F.octet_length("_text").cast("bigint").alias("n_bytes"),
        F.xxhash64("_text").alias("check"),
    )


def merged(rows: DataFrame, leaves: int = LEAVES, fan_in: int = FAN_IN) -> DataFrame:
    """Per (key, digest): ``keep``, the largest key of its digest, and ``group_size``.

    Two rows with the same key and digest are two copies. A null id has the largest key of all, so such a
    row stays in place of rows with ids.
    """
    run = rows.groupBy(*SAME, "key").agg(F.count(F.lit(1)).alias("n"))
    run = landed(run.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(leaves))), "digest-rows")
    levels = [run.groupBy(*SAME, "block").agg(F.max("key").alias("keep"), F.sum("n").alias("n"))]
    blocks = leaves
    while blocks > 1:
        blocks = -(-blocks // fan_in)
        levels[-1] = landed(levels[-1], "digest-run")
        below = levels[-1].withColumn("block", F.floor(F.col("block") / F.lit(fan_in)).cast("bigint"))
        levels.append(below.groupBy(*SAME, "block").agg(F.max("keep").alias("keep"), F.sum("n").alias("n")))
    top = levels.pop().select(*SAME, "block", "keep", F.col("n").alias("group_size"))
    for level in reversed(levels):
        up = level.select(*SAME, "block", F.floor(F.col("block") / F.lit(fan_in)).cast("bigint").alias("above"))
        top = up.join(top.withColumnRenamed("block", "above"), [*SAME, "above"]).select(*SAME, "block", "keep", "group_size")
    return run.join(top, [*SAME, "block"]).select("key", *SAME, "keep", "group_size")


def exact_duplicates(docs: DataFrame, leaves: int = LEAVES, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (texts are equal but for the case of A-Z).

    Null texts count as empty, so they are copies of each other. Rows that repeat both id and text are each
    counted in ``group_size`` and give one row of the result each. Other columns of ``docs`` are not read.
    """
    rows = landed(digests(docs), "digests")
    found = merged(rows, leaves, fan_in)
    return rows.join(found, ["key", *SAME]).select(
        doc_id(), doc_id("keep").alias("keep_id"), F.col("group_size").cast("bigint").alias("group_size"),
        (F.col("key") == F.col("keep")).alias("kept"), "text_sha256",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with their columns unchanged."""
    columns = docs.columns
    kept = merged(digests(docs)).filter(F.col("key") == F.col("keep")).select("key", "text_sha256").distinct()
    text = lowered(F.coalesce(F.col("text"), F.lit("")))
    marked = docs.select(
        *[F.col(name).alias(f"c_{at}") for at, name in enumerate(columns)],
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("key"), F.sha2(text.cast("binary"), 256).alias("text_sha256"),
    )
    first = Window.partitionBy("key", "text_sha256").orderBy(*[f"c_{at}" for at in range(len(columns))])
    return (
        marked.join(kept, ["key", "text_sha256"], "left_semi").withColumn("_nth", F.row_number().over(first)).filter("_nth = 1")
        .select(*[F.col(f"c_{at}").alias(name) for at, name in enumerate(columns)])
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""
