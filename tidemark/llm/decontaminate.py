"""Test items inside documents: size-partitioned MinHash containment search, then exact containment.

Items are parted by size: class c holds those with 2**c to 2**(c+1) - 1 distinct shingles. An item's
signature is its bottom-k MinHash sketch, the k smallest shingle hashes, with one k for each class: an item of
n shingles that is contained to ``share`` lacks at most n - ceil(share * n) of them in the document, so one more
value than that cannot all be lacking. Any k at or above this finds every contained item; the class's upper bound
gives it. A document looks up all its shingle hashes, however long it is, in the signatures of the classes that
its own size admits, and the pairs found are verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, doc_id, landed, likely, lowered, read, text_keys

WIDTH = 5
SHARE = 0.8


def _words(text: Column) -> Column:
    return F.filter(F.split(lowered(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda word: word != "")


def _every(words: str, width: int, value) -> Column:
    """``value`` of the words of each shingle; none where there are fewer words."""
    size = F.size(words)
    places = F.when(size >= width, F.sequence(F.lit(0), size - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda at: value(*[F.get(F.col(words), at + step) for step in range(width)]))


def item_shingles(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, shingle, hash, n): the distinct shingles of every item; items of fewer words have none."""
    split = items.select("item_id", _words(F.col("text")).alias("words")).filter(F.size("words") >= width)
    rows = split.select("item_id", F.explode(F.array_distinct(_every("words", width, lambda *w: F.concat_ws(" ", *w)))).alias("shingle")).distinct()
    sizes = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    hashed = rows.withColumn("hash", F.xxhash64(*[F.get(F.split("shingle", " "), F.lit(step)) for step in range(width)]))
    return hashed.join(sizes, "item_id")


def signatures(shingles: DataFrame, share: float = SHARE) -> DataFrame:
    """(item_id, n, hash): the bottom-k sketch of each item, k by size class."""
    top = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n").cast("double"))) + 1) - 1
    k = (top - F.ceil(F.lit(share) * top - 1e-9) + 1).cast("int")
    return (
        shingles.groupBy("item_id", "n").agg(F.array_sort(F.collect_set("hash")).alias("hashes"))
        .select("item_id", "n", F.explode(F.slice("hashes", F.lit(1), k)).alias("hash"))
    )


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """(key, mark, item_id, n_item_shingles, n_shared, containment) of every pair with at least ``share`` of the item's shingles.

    Null and empty texts and texts of fewer than ``width`` words hold nothing; such items match nothing. Items that
    repeat an id are taken together. Rows of ``docs`` that repeat an id, or have none, are judged each different text on its own; equal
    rows count once. Other columns are not read. The joins carry no hint: the signatures are a written table, so Spark broadcasts them only below
    its own size limit and shuffles both sides beyond it.
    """
    by = ("key", "mark")
    shingles = landed(item_shingles(items.filter("item_id is not null"), width), "item-shingles")
    wanted = landed(signatures(shingles, share), "item-signatures")
    keyed = text_keys(docs).select(*by, "text")
    split = keyed.select(*by, _words(F.col("text")).alias("words")).filter(F.size("words") >= width)
    hashes = split.select(*by, F.size("words").alias("size"), F.explode(_every("words", width, F.xxhash64)).alias("hash"))
    admits = (F.col("size") - width + 1) >= F.lit(share) * F.col("n") - 1e-9
    met = landed(hashes.join(wanted, "hash").filter(admits).select(*by, "item_id").distinct(), "contained-candidates")

    # Suspects are distinct, so the join keeps rows as they are; a semi join would be pushed below the filter, which then filters nothing before the shuffle.
    suspects = met.select(*by).distinct()
    again = likely(keyed, suspects, by).join(suspects, list(by)).select(*by, _words(F.col("text")).alias("words"))
    texts = again.select(*by, F.explode(_every("words", width, lambda *w: F.concat_ws(" ", *w))).alias("shingle")).distinct()
    shared = texts.join(shingles, "shingle").groupBy(*by, "item_id", "n").agg(F.count(F.lit(1)).alias("n_shared"))
    return shared.join(met, [*by, "item_id"], "left_semi").filter(F.col("n_shared") >= F.lit(share) * F.col("n") - 1e-9).select(
        *by, "item_id", F.col("n").alias("n_item_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"),
    )


def without_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose own text holds no test item, with their columns unchanged."""
    by = ("key", "mark")
    leaked = landed(contained_items(docs, items).select(*by).distinct(), "contaminated")
    columns = docs.columns
    plain = docs.select(
        *[F.col(name).alias(f"c_{at}") for at, name in enumerate(columns)], F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("key"),
        F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("mark"))
    return plain.join(leaked, list(by), "left_anti").select(*[F.col(f"c_{at}").alias(name) for at, name in enumerate(columns)])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(doc_id(), "item_id", "n_item_shingles", "n_shared", "containment")


OP6_SQL = """
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, coalesce(text, '') AS one, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM (SELECT DISTINCT doc_id, text FROM documents)
  UNION ALL
  SELECT 1, item_id, '', list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM benchmark
), s AS (
  SELECT DISTINCT kind, id, one, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] || ' ' || words[i + 4] AS shingle
  FROM (SELECT kind, id, one, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), n AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 AND id IS NOT NULL GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n.n) AS n_item_shingles, count(*) AS n_shared, count(*) / any_value(n.n) AS containment
FROM s d JOIN s i ON d.shingle = i.shingle AND d.kind = 0 AND i.kind = 1 JOIN n ON n.id = i.id
GROUP BY d.id, d.one, i.id HAVING count(*) >= 0.8 * any_value(n.n) - 1e-9
"""
