"""Sources mixed to target weights: words per source, repetition rates, whole copies and one drawn copy.

A first pass adds up the words of each source. Targets share all words by weight, none above ``most`` times what its
source has; the excess goes to the others by weight, which is one level for the whole table: a source takes the lesser of its
bound and level * weight. Sorted by bound / weight, running sums give that level, so no source is visited twice.
A second pass emits each document floor(rate) times and once more if a draw, seeded by the document's own hash,
falls below the fraction. Documents never move between tasks; only sums do.

With draws as they fall, a source of 50 documents missed its target by up to 37 percent and one of 1,700 by up to 6, because a few documents
hold many of the words. So each source's cut is the multiple of 1/CUTS at which the words taken come nearest to the fraction: the words of each
stretch of draws are added up first. Which documents are taken still depends on their draws alone, and each is with nearly the fraction as its probability.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import dense_index, running
from .common import landed, n_words, read

WEIGHTS = (5, 2, 1)
MOST = 3
# Hexadecimal digits of a draw; a double holds 13 of them exactly.
DIGITS = 13
# Places where the draws of a source may be cut.
CUTS = 4096


def _draw() -> Column:
    """A number in [0, 1) that depends on nothing but the document's id and text."""
    seed = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(seed), 1, DIGITS), 16, 10).cast("bigint") / F.lit(float(16**DIGITS))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, draw) of every row."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _draw().alias("draw"))


def source_rates(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate, cut) of every source of ``sizes`` (source, size, draw), as a landed table.

    Sources are ordered by code point, null last, and take the weights in turn. A source without words has target, rate and cut 0.
    """
    stretches = landed(sizes.groupBy("source", F.floor(F.col("draw") * CUTS).cast("bigint").alias("stretch")).agg(F.sum("size").alias("words")), "stretches")
    totals = dense_index(stretches.groupBy("source").agg(F.sum("words").alias("source_size")), [F.col("source").asc_nulls_last()], out="rank")
    weight = F.get(F.array(*[F.lit(one) for one in weights]), F.pmod("rank", F.lit(len(weights))).cast("int"))
    bounded = totals.select("source", "source_size", weight.cast("bigint").alias("weight"), (F.col("source_size") * most).alias("bound"))
    placed = dense_index(bounded.withColumn("ratio", F.col("bound") / F.col("weight")), ["ratio", F.col("source").asc_nulls_last()], out="at")
    sums = landed(running(placed, [], "at", {"held": F.col("bound"), "spent": F.col("weight")}), "source-sums")
    whole = sums.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weights")).first()
    level = (F.lit(whole.words) - F.col("held")) / (F.lit(whole.weights) - F.col("spent"))
    first = sums.filter(level <= F.col("ratio")).agg(F.min(F.struct("at", "held", "spent")).alias("one")).select("one.*").first()
    if first.at is None:  # no source at all
        first = first.__class__(0, 0, 0)
    at, held, spent = first
    free = (F.lit(whole.words - held) * F.col("weight")).cast("double") / F.lit(float(whole.weights - spent))
    target = F.when(F.col("at") < at, F.col("bound").cast("double")).otherwise(free)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rates = landed(sums.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate")), "source-rates")
    # Running sums are joined by key, which a null source would not survive.
    named = stretches.select(F.col("source").isNotNull().alias("known"), F.coalesce("source", F.lit("")).alias("name"), "stretch", "words")
    upto = running(named, ["known", "name"], "stretch", {"sum": F.col("words")}, inclusive=True).select(F.when(F.col("known"), F.col("name")).alias("source"), "stretch", "sum")
    return landed(_with_cut(rates, upto), "source-cuts")


def _with_cut(rates: DataFrame, upto: DataFrame) -> DataFrame:
    """``rates`` with the ``cut`` whose words come nearest to the fraction of the source, the lower of equal ones; ``upto`` has the words up to each stretch."""
    marks = upto.select(F.col("source").alias("_source"), (F.col("stretch") + 1).alias("place"), "sum")
    marks = marks.unionByName(rates.select(F.col("source").alias("_source"), F.lit(0).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("sum")))
    goal = (F.col("rate") - F.floor("rate")) * F.col("source_size")
    near = marks.join(rates, F.col("_source").eqNullSafe(F.col("source"))).groupBy("_source").agg(F.min(F.struct(F.abs(F.col("sum") - goal).alias("off"), "place")).alias("best"))
    return rates.join(near, F.col("_source").eqNullSafe(F.col("source"))).select(*rates.columns, (F.col("best.place") / F.lit(float(CUTS))).alias("cut"))


def with_copies(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """``rows`` (source, draw and others) with source_size, target, rate, cut and ``copies``, the times the mix takes each."""
    copies = F.floor("rate") + F.when(F.col("draw") < F.col("cut"), 1).otherwise(0)
    right = rates.withColumnRenamed("source", "_source")
    return rows.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("copies", copies.cast("bigint"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of the mix: every document as often as it is taken, its columns unchanged.

    A word is a run of anything but the six blanks; null and empty texts have none. A null source is one source. Rows that repeat
    both id and text share a draw, so all of them or none get the drawn copy; rows without an id differ by their texts. A source
    strays from its target by about half of the words of one stretch of draws, which is half a document where it has few. The same table gives the same mix on each run, whatever its
    partitions. An empty table gives none.
    """
    rates = source_rates(measured(docs), weights, most)
    columns = docs.columns
    rows = docs.select(*[F.col(name).alias(f"c_{at}") for at, name in enumerate(columns)], "source", _draw().alias("draw"))
    return with_copies(rows, rates).withColumn("copy", F.explode(F.sequence(F.lit(1), F.nullif("copies", F.lit(0))))).select(
        *[F.col(f"c_{at}").alias(name) for at, name in enumerate(columns)])


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = landed(measured(read(spark, sf_dir, "documents")), "sizes")
    return with_copies(sizes, source_rates(sizes)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "rate", "cut", "copies")


OP13_SQL = """
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source
), o AS (
  SELECT *, 3 * source_size AS bound, row_number() OVER w AS place, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights,
         coalesce(sum(3 * source_size) OVER b, 0) AS held, coalesce(sum(weight) OVER b, 0) AS spent
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST), b AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), k AS (SELECT min(place) AS place FROM o WHERE (words - held)::DOUBLE / (weights - spent)::DOUBLE <= bound::DOUBLE / weight),
f AS (SELECT o.place, o.held, o.spent FROM o JOIN k ON o.place = k.place),
r AS (
  SELECT source, source_size, CASE WHEN o.place < f.place THEN bound::DOUBLE ELSE ((words - f.held) * weight)::DOUBLE / (weights - f.spent)::DOUBLE END AS target FROM o, f
), q AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate FROM r),
h AS (SELECT source, floor(draw * 4096)::BIGINT AS stretch, sum(size) AS words FROM d GROUP BY ALL),
u AS (SELECT source, stretch + 1 AS place, sum(words) OVER (PARTITION BY source ORDER BY stretch) AS total FROM h UNION ALL SELECT source, 0, 0 FROM q),
m AS (SELECT u.source, place, abs(total - (rate - floor(rate)) * source_size) AS off FROM u JOIN q ON u.source IS NOT DISTINCT FROM q.source),
b AS (SELECT source, place / 4096.0::DOUBLE AS cut FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off, place) AS n FROM m) WHERE n = 1)
SELECT d.doc_id, d.size, q.source_size, q.target, d.size * (floor(q.rate) + CASE WHEN d.draw < b.cut THEN 1 ELSE 0 END)::BIGINT AS taken, d.source, q.rate, b.cut,
       (floor(q.rate) + CASE WHEN d.draw < b.cut THEN 1 ELSE 0 END)::BIGINT AS copies
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
