"""Repeated word passages by seed and extend.

Winnowed anchors (five-word seeds, chosen by content, at least one in each window of 13 words) of all documents
are joined on their seed. A match is extended to both sides of the seed as far as a window of 13 words reaches;
here a segment holds all those extensions at once, and its digest, or where segments differ the digests
of its windows, says how far a match goes. Neighbouring covered windows merge into maximal passages of 13 words
and more. Since a passage only needs the smallest id that holds it, each seed keeps a minimum per
extension and documents never meet in pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchored import Units, covered_units, hits, looked_up, runs_of, several, spans
from .common import chunks, discarded, doc_id, landed, read, row_keys, table

LENGTH = 13
SEED = 5
OUT = "key bigint, mark binary, kept string, n_words bigint, n_removed bigint, spans array<int>, kept_sha256 string"


def _windows(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A row for each window of the wanted segments: its digest, and its place in the segment."""
    for batch, data, ends in chunks(batches):
        units = Units(data, ends, True)
        began = np.concatenate([[0], units.ends[:-1]])
        lists = batch.column("wanted")
        doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        flat = lists.flatten()
        at = flat.field("at").to_numpy()
        many = at & 255
        row = np.repeat(np.arange(len(at)), many)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        digest = units.two.at((began[doc] + (at >> 8))[row] + nth, length)
        pick = pa.array(row)
        yield table({
            "seed": (flat.field("seed").take(pick), None), "seg": (flat.field("seg").take(pick), None), "first": (flat.field("first").take(pick), None),
            "nth": (nth, pa.int32()), "window": (digest.view(np.int64), pa.int64()),
        })


def _removed(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, sizes, gone, found, digests = [], [], [], [], []
        lists = batch.column("spans")
        for text, some in zip(batch.column("text").to_pylist(), lists):
            words = text.encode().split()
            flags = covered_units(len(words), some.values, length) if some.is_valid else np.zeros(len(words), bool)
            n = int(flags.sum())
            kept = b" ".join(compress(words, ~flags) if n else words)
            texts.append(kept.decode())
            sizes.append(len(words))
            gone.append(n)
            found.append(runs_of(flags) if n else [])
            digests.append(hashlib.sha256(kept).hexdigest())
        yield table({
            "key": (batch.column("key"), None), "mark": (batch.column("mark"), None), "kept": (texts, pa.string()), "n_words": (sizes, pa.int64()),
            "n_removed": (gone, pa.int64()), "spans": (found, pa.list_(pa.int32())), "kept_sha256": (digests, pa.string()),
        })


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Per document: key, mark, kept text, n_words, n_removed, spans (first and last word of each passage), kept_sha256.

    A word goes when a window of ``length`` words of its document over it also starts in a document with a smaller id.
    Words are parted by the six blanks and not changed; kept ones are joined by one blank. A null text has no words.
    A null id counts as larger than any other and equal to other null ids; rows with one id never take words from
    each other. Other columns of ``docs`` are not read.
    """
    keyed = row_keys(docs)
    found = hits(keyed, length, seed, True, F.col("least") < F.col("most"))
    segments = landed(found.groupBy("seed", "seg").agg(F.min("key").alias("first"), F.max("key").alias("last")), "segments")
    open_ = segments.join(several(segments), "seed", "left_semi")
    holders = found.join(open_.select("seed", "seg", F.col("first").alias("key")), ["seed", "seg", "key"], "left_semi").groupBy("seed", "seg", "key").agg(F.min(F.struct("mark", "at")).alias("one"))
    wanted = landed(holders.select("key", "one.mark", "one.at", "seed", "seg", F.col("key").alias("first")), "holders")
    windows = looked_up(keyed, wanted).mapInArrow(partial(_windows, length=length), "seed bigint, seg bigint, first bigint, nth int, window bigint")
    windows = landed(windows, "windows")
    earliest = landed(windows.groupBy("seed", "window").agg(F.min("first").alias("earliest"), F.max("first").alias("latest")).filter("earliest < latest").select("seed", "window", "earliest"), "earliest")
    early = windows.join(earliest, ["seed", "window"]).filter("earliest < first")
    runs = landed(early.groupBy("seed", "seg").agg(F.collect_set("nth").alias("nths")).select("seed", "seg", F.flatten(F.transform("nths", lambda x: F.array(x, x))).alias("runs")), "runs")
    discarded(wanted, windows, earliest)

    # A segment that stands in one document only, and none of whose windows is earlier elsewhere, covers nothing.
    verdicts = landed(segments.join(runs, ["seed", "seg"], "left").filter("first < last or runs is not null"), "verdicts")
    covers = found.join(verdicts, ["seed", "seg"]).filter("first < key or runs is not null").select(
        "key", "mark", "at", F.when(F.col("first") == F.col("key"), F.col("runs")).alias("runs"))
    return keyed.join(spans(covers), ["key", "mark"], "left").select("key", "mark", "text", "spans").mapInArrow(partial(_removed, length=length), OUT)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents")).select(doc_id(), "n_words", "n_removed", "kept_sha256")


OP1_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), v AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS v FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)
), f AS (SELECT v, min(doc_id) AS first FROM v GROUP BY v),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM v JOIN f USING (v) WHERE first < doc_id),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM w)
SELECT w.doc_id, any_value(len(w.words)) AS n_words, count(c.place) AS n_removed,
       sha256(coalesce(string_agg(p.word, ' ' ORDER BY p.place) FILTER (c.place IS NULL AND p.word IS NOT NULL), '')) AS kept_sha256
FROM w LEFT JOIN p ON p.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = p.doc_id AND c.place = p.place
GROUP BY w.doc_id
"""
