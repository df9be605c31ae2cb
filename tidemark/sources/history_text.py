"""Text exports of version control as tables: line counts, raw changes, and scans over files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
ZERO = "0" * 40
MARK = r"""pytest\.mark\.(\w+)(?:\((['"])(.*?)\2\))?"""
FROM = r"(?im)^\s*FROM\s+(\S+)"
INCLUDE = r"""\{%\s*include\s+['"]([^'"]+)['"]"""
APT = r"\bapt-get\b|\bapt\b"
TOPOLOGY_MARKS = ("topology", "topologies")
FROM_KEPT = 12
INCLUDES_KEPT = 20


def numstat(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, additions, deletions, binary) of ``added TAB deleted TAB path`` lines; two dashes mean binary.

    A moved path keeps its new side. Lines with fewer fields are left out; counts that are no numbers fail.
    """
    part = F.split(column, "\t")
    arrow = " => "
    new_side = F.substring_index(part[2], arrow, -1)
    moved = F.regexp_replace(F.regexp_replace(new_side, r"^\{+|\{+$", ""), r"^\}+|\}+$", "")
    binary = (part[0] == "-") & (part[1] == "-")
    keep = [name for name in lines.columns if name != column]
    return lines.filter(F.size(part) >= 3).select(
        *keep, F.when(part[2].contains(arrow), moved).otherwise(part[2]).alias("path"),
        F.when(~binary, part[0].cast("bigint")).alias("additions"), F.when(~binary, part[1].cast("bigint")).alias("deletions"),
        binary.alias("binary"),
    )


def join_counts(raw: DataFrame, counts: DataFrame) -> DataFrame:
    """Raw changes with their line counts; a change without counts is an error.

    ``raw(sha, status, old_path, new_path, old_mode, new_mode, old_blob, new_blob)``, ``counts(sha, old_path,
    new_path, additions, deletions, binary)`` with ``old_path`` only for moves and copies.
    """
    moves = F.col("status").isin("R", "C")
    keyed = raw.withColumn(
        "_key", F.when(moves, F.concat("old_path", F.lit("\0"), "new_path")).otherwise(F.coalesce("new_path", "old_path"))
    )
    number = counts.select(
        "sha", F.when(F.col("old_path").isNotNull(), F.concat("old_path", F.lit("\0"), "new_path")).otherwise(F.col("new_path")).alias("_key"),
        "additions", "deletions", "binary",
    )
    found = keyed.join(number, ["sha", "_key"], "left")
    lost = F.raise_error(F.concat(F.lit("no line counts for "), F.coalesce("new_path", "old_path")))
    blank = lambda name, value: F.when(F.col(name) != value, F.col(name)).alias(name)
    return found.select(
        "sha", "status", "old_path", "new_path", blank("old_mode", "000000"), blank("new_mode", "000000"),
        blank("old_blob", ZERO), blank("new_blob", ZERO), "additions", "deletions",
        F.when(F.col("binary").isNull(), lost.cast("boolean")).otherwise(F.col("binary")).alias("binary"),
    )


def read_texts(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, text) of whole files."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def topology_marks(files: DataFrame) -> DataFrame:
    """(path, topology) named by topology marks of test files; ``files(path, text)``.

    The quoted argument counts whole and in its comma- or space-separated parts; without one the mark's name.
    """
    names = F.regexp_extract_all("text", F.lit(MARK), 1)
    arguments = F.regexp_extract_all("text", F.lit(MARK), 3)
    marks = files.select("path", F.explode(F.arrays_zip(names.alias("name"), arguments.alias("arg"))).alias("m")).filter(
        F.col("m.name").isin(*TOPOLOGY_MARKS)
    )
    whole = F.when(F.col("m.arg") != "", F.col("m.arg")).otherwise(F.col("m.name"))
    pieces = F.transform(F.split("m.arg", r"[,\s]+"), lambda piece: F.regexp_replace(piece, r"""^[ '"]+|[ '"]+$""", ""))
    found = marks.select("path", F.explode(F.concat(F.array(whole), pieces)).alias("topology"))
    return found.filter("topology <> ''").distinct()


def topology_counts(marks: DataFrame) -> DataFrame:
    return marks.groupBy("topology").agg(F.count(F.lit(1)).alias("files"))


def image_files(files: DataFrame, bases_kept: int | None = None, includes_kept: int | None = None) -> DataFrame:
    """Base images, template includes and package-manager mentions of image build files.

    With limits the lists are cut; ``n_bases`` and ``n_includes`` count all.
    """
    kept = lambda name, limit: F.col(name) if limit is None else F.slice(name, 1, limit).alias(name)
    bases = F.regexp_extract_all("text", F.lit(FROM), 1)
    includes = F.regexp_extract_all("text", F.lit(INCLUDE), 1)
    row = files.select("path", bases.alias("bases"), includes.alias("includes"), F.regexp_count("text", F.lit(APT)).alias("apt_mentions"))
    return row.filter((F.size("bases") > 0) | (F.size("includes") > 0) | (F.col("apt_mentions") > 0)).select(
        "path", kept("bases", bases_kept), kept("includes", includes_kept), "apt_mentions", F.size("bases").alias("n_bases"), F.size("includes").alias("n_includes")
    )
