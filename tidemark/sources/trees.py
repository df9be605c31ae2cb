"""Tree listings, blobs and fixtures as tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import directory

LISTING = r"^(\d{6}) (\w+) ([0-9a-f]+)\t(.*)$"


def tree_listing(lines: DataFrame, column: str = "value") -> DataFrame:
    """(mode, kind, sha, path) of ``mode kind sha<TAB>path`` lines; other lines are left out."""
    part = lambda n: F.regexp_extract(column, LISTING, n)
    return lines.filter(F.col(column).rlike(LISTING)).select(
        part(1).alias("mode"), part(2).alias("kind"), part(3).alias("sha"), part(4).alias("path")
    )


def paths_matching(tree: DataFrame, regex: str) -> DataFrame:
    return tree.filter(F.col("path").rlike(regex)).select("path")


def directories_containing(tree: DataFrame, regex: str) -> DataFrame:
    return tree.filter(F.col("path").rlike(regex)).select(directory(F.col("path")).alias("directory")).distinct()


def path_count(tree: DataFrame, prefix: str = "") -> DataFrame:
    inside = tree if not prefix else tree.filter((F.col("path") == prefix) | F.col("path").startswith(prefix + "/"))
    return inside.agg(F.count(F.lit(1)).alias("n"))


def dedupe_reads(
    entries: DataFrame, key: str, content: Sequence[str], parse: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Parse each distinct blob once and join the result back to every entry that holds it.

    ``repeated`` tells entries that shared a read. ``parse`` takes and returns one row per blob.
    """
    blobs = entries.groupBy(key).agg(
        *[F.any_value(name).alias(name) for name in content], (F.count(F.lit(1)) > 1).alias("repeated")
    )
    return entries.drop(*content).join(parse(blobs), key).join(blobs.select(key, "repeated"), key)


def missing_blobs(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """Entries of a pinned tree whose blob the fixture does not hold; a fixture with any is incomplete."""
    return entries.join(blobs.select("sha"), "sha", "left_anti")


def fixture(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """Entries with their content; a missing blob raises when the row is read."""
    row = entries.join(blobs.select("sha", "content"), "sha", "left")
    lost = F.raise_error(F.concat(F.lit("fixture lacks blob "), "sha", F.lit(" of "), "path"))
    return row.withColumn("content", F.when(F.col("content").isNull(), lost).otherwise(F.col("content")))
