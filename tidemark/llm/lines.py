"""Lines that many documents share: explode, hash, count documents per hash, drop, put together again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, doc_id, landed, lowered, read, row_keys, table

MIN_CHARS = 40
MIN_DOCS = 5
OUT = "key bigint, text string, n_lines bigint, n_dropped bigint, kept_sha256 string"


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, mark, places): per document the positions of the lines it loses.

    The key of a line is the line without blanks at its ends and with A-Z in lower case. Keys of at least
    ``min_chars`` code points in at least ``min_docs`` documents (ids) stay only in the document with the
    largest id. Occurrences shrink to one row per (hash, document) first, so a line that stands in a third
    of all documents is spread over as many rows as it has documents until its count is known.
    """
    lines = row_keys(docs).select("key", "mark", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    keyed = lines.select("key", "mark", "place", lowered(F.trim(F.col("line"), F.lit(BLANKS))).alias("line"))
    hashed = keyed.filter(F.length("line") >= min_chars).select("key", "mark", "place", F.unhex(F.md5("line")).alias("hash"))
    held = landed(hashed, "line-hashes")
    counted = landed(
        held.select("hash", "key").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("stays"))
        .filter(F.col("n") >= min_docs).select("hash", "stays"), "repeated-lines")
    lost = held.join(counted, "hash").filter(F.col("key") != F.col("stays"))
    return lost.groupBy("key", "mark").agg(F.collect_set("place").alias("places"))


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, sizes, drops, digests = [], [], [], []
        for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
            n, gone = text.count("\n") + 1, ()
            if places:
                gone = set(places)
                text = "\n".join([line for at, line in enumerate(text.split("\n")) if at not in gone])
            texts.append(text)
            sizes.append(n)
            drops.append(len(gone))
            digests.append(hashlib.sha256(text.encode()).hexdigest())
        yield table({
            "key": (batch.column("key"), None), "text": (texts, pa.string()), "n_lines": (sizes, pa.int64()), "n_dropped": (drops, pa.int64()),
            "kept_sha256": (digests, pa.string()),
        })


def without_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document: key, the text that is left, n_lines before, n_dropped, kept_sha256 of the text that is left.

    A null or empty text is one empty line. Rows that repeat an id count as one document when documents are
    counted; each still gives a row. Other columns of ``docs`` are not read.
    """
    lost = repeated_lines(docs, min_chars, min_docs)
    return row_keys(docs).join(lost, ["key", "mark"], "left").select("key", "text", "places").mapInArrow(_kept, OUT)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_lines(read(spark, sf_dir, "documents")).select(doc_id(), "n_lines", "n_dropped", "kept_sha256")


OP4_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (SELECT k.*, c.stays IS NOT NULL AND c.stays <> k.doc_id AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
