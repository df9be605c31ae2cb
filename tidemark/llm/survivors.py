"""How five filters interact: survivors of every subset of them, counted once for all orders.

Each document becomes a 32-bit word: bit s says whether it survives the subset s of the filters. Words of one part and label are
counted by position with carry-save adders: three words of a weight give a sum of that weight and a carry of twice the weight, until
two are left, so bits are unpacked for a few words only. The 32 counts per part and label hold the answer for
every order, because what a filter removes at its step is the survivors of the filters before it less those of one more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, landed, n_words, parted, read, table

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
EVERY = SUBSETS - 1
# Word of the documents that fail exactly the filters of f: the subsets without any of them.
WORDS = [sum(1 << s for s in range(SUBSETS) if not f & s) for f in range(SUBSETS)]
COUNTED = "part string, subset int, n bigint, n_good bigint, n_toxic bigint"


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, fails): the filters A to D that each document fails, as bits; E needs the whole table."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    counts = plain.select("doc_id", "part", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), parted(F.col("text")).alias("words"))
    distinct = F.size(F.array_distinct("words"))
    chars = F.length("text")
    tests = [F.size("words") < 100, 100 * distinct < 80 * F.size("words"), 100 * (chars - F.length(F.translate("text", UPPER, ""))) > 10 * chars, F.col("text").rlike("[#$%&*|]")]
    return counts.select("doc_id", "part", "digest", sum((F.when(test, 1 << at).otherwise(0) for at, test in enumerate(tests)), F.lit(0)).alias("fails"))


def survival_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, word) of every row of ``docs``.

    Null texts are empty, a null lang is the part "". Filter E fails a row whose text stands under a smaller doc_id; a null id is larger
    than any other, and rows of one id never fail each other. A document is good or toxic if any label row of its id says so.
    """
    marked = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    judged = landed(failures(docs), "failures")
    # The join with the first of each text asks for the id as well, so no key of it is common, however many copies a text has.
    firsts = judged.groupBy("digest").agg(F.min("doc_id").alias("least")).select(F.col("digest").alias("_digest"), "least", F.lit(True).alias("first"))
    met = judged.join(firsts, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("least")), "left")
    fails = F.col("fails") + F.when(F.col("first"), 0).otherwise(1 << 4)
    no = F.lit(False)
    return met.select("doc_id", "part", fails.alias("fails")).join(marked, "doc_id", "left").select(
        "part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), F.get(F.array(*[F.lit(word).cast("bigint") for word in WORDS]), F.col("fails")).alias("word"))


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of ``words`` (uint32) have each of the 32 bits, by carry-save addition."""
    counts, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = []
        while len(words) > 2:
            third = len(words) // 3
            one, two, three, rest = words[:third], words[third: 2 * third], words[2 * third: 3 * third], words[3 * third:]
            half = one ^ two
            carries.append((one & two) | (half & three))
            words = np.concatenate([half ^ three, rest])
        for word in words.tolist():
            counts += weight * ((word >> np.arange(32)) & 1)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return counts


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column("part").dictionary_encode()
        place = parts.indices.to_numpy()
        order = np.argsort(place, kind="stable")
        words, good, toxic = (batch.column(name).to_numpy(zero_copy_only=False)[order] for name in ("word", "good", "toxic"))
        words, edges = words.astype(np.uint32), np.searchsorted(place[order], np.arange(len(parts.dictionary) + 1))
        for at, part in enumerate(parts.dictionary.to_pylist()):
            here = slice(edges[at], edges[at + 1])
            counts = [positional_counts(some) for some in (words[here], words[here][good[here]], words[here][toxic[here]])]
            yield table({
                "part": ([part] * SUBSETS, pa.string()), "subset": (np.arange(SUBSETS), pa.int32()), "n": (counts[0], pa.int64()), "n_good": (counts[1], pa.int64()),
                "n_toxic": (counts[2], pa.int64()),
            })


def subset_survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, subset, n, n_good, n_toxic): documents of each part, and labelled ones, that survive each subset of the filters."""
    return survival_words(docs, labels).mapInArrow(_counted, COUNTED).groupBy("part", "subset").agg(*[F.sum(name).alias(name) for name in ("n", "n_good", "n_toxic")])


def _field(rows: str, name: str) -> Column:
    return F.transform(rows, lambda row: row[name])


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    See ``survival_words`` for nulls, repeated ids and texts. An empty table has no parts and no rows. Other columns are not read.
    """
    counts = landed(subset_survivors(docs, labels), "survivors")
    # A part has exactly 32 rows here.
    lists = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", "n_good", "n_toxic"))).alias("rows")).select(
        "part", *[_field("rows", name).alias(name) for name in ("n", "n_good", "n_toxic")])
    shares = []
    for at in range(len(FILTERS)):
        bit = 1 << at
        others = [s for s in range(SUBSETS) if not s & bit]
        weight = lambda s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())
        shares.append(sum((weight(s) * (F.get("n", F.lit(s)) - F.get("n", F.lit(s | bit))) for s in others), F.lit(0)))
    orders = F.split(F.lit(" ".join("".join(one) for one in permutations(FILTERS))), " ")
    steps = lists.withColumn("shapleys", F.array(*shares)).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = lambda letter: F.ascii(letter) - ord(FILTERS[0])
    letters = F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda at: F.call_function("shiftleft", F.lit(1), place(F.substr("filter_order", at, F.lit(1)))))
    placed = steps.withColumn("mine", place(F.substr("filter_order", F.col("step"), F.lit(1)))).withColumn(
        "before", F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b))
    bit = F.call_function("shiftleft", F.lit(1), F.col("mine"))
    lost = lambda name: F.get(name, F.col("before")) - F.get(name, F.col("after"))
    failing = F.get("n", F.lit(0)) - F.get("n", F.col("bit"))
    numbers = [
        F.get("n", F.col("after")).alias("kept"), lost("n").alias("removed"), (failing - lost("n")).alias("redundant"),
        (F.get("n", F.lit(EVERY) - F.col("bit")) - F.get("n", F.lit(EVERY))).alias("unique_fails"), lost("n_good").alias("good_lost"), lost("n_toxic").alias("toxic_lost"),
        F.get("shapleys", F.col("mine")).alias("shapley"),
    ]
    return placed.withColumn("bit", bit).withColumn("after", F.col("before") + F.col("bit")).select("part", "filter_order", "step", *[one.cast("bigint").alias(name) for one, name in zip(numbers, (
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))])


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map {
    'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
    'C': 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text), 'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), min(doc_id) OVER (PARTITION BY text) IS NOT NULL)} AS fails
  FROM d LEFT JOIN l USING (doc_id)
), g AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT [p.x, q.x, r.x, s.x, t.x] AS o FROM a p JOIN a q ON q.x <> p.x JOIN a r ON r.x NOT IN (p.x, q.x) JOIN a s ON s.x NOT IN (p.x, q.x, r.x)
  JOIN a t ON t.x NOT IN (p.x, q.x, r.x, s.x)
), p AS (SELECT o, unnest(range(1, 6))::INT AS step FROM o),
e AS (
  SELECT part, array_to_string(o, '') AS filter_order, step, o[step] AS mine, good, toxic, n, fails[o[step]] AS failing,
         len(list_filter(o[1:step - 1], lambda x: fails[x])) > 0 AS earlier, len(list_filter(o, lambda x: fails[x])) AS many
  FROM g, p
), c AS (
  SELECT part, filter_order, step, mine, coalesce(sum(n) FILTER (NOT earlier AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT earlier AND failing), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (earlier AND failing), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failing AND many = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (NOT earlier AND failing AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT earlier AND failing AND toxic), 0)::BIGINT AS toxic_lost
  FROM e GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, mine))::BIGINT AS shapley FROM c
"""
