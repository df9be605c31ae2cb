"""Patches as tables: numbering, caps, paired lines, first runs, and line origins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import comment_markers, indentation_matters, line_kind, squeeze

# Fixed values.
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def patch_lines(patches: DataFrame, keys: tuple[str, ...] = ("sha", "path"), column: str = "patch") -> DataFrame:
    """(keys.., pos, line) of patch texts."""
    return patches.select(*keys, F.posexplode(F.split(column, "\n")).alias("pos", "line"))


def number_lines(lines: DataFrame, keys: tuple[str, ...] = ("sha", "path")) -> DataFrame:
    """Hunk number, kind and both line numbers of every line of a patch.

    A window covers the lines of one file's patch, which arrived as one value of one row.
    """
    header = F.col("line").rlike(HUNK)
    so_far = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    in_hunk = Window.partitionBy(*keys, "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    first = F.left(F.col("line"), F.lit(1))
    kind = (
        F.when(header, "header").when(first == "+", "added").when(first == "-", "removed")
        .when(first == "\\", "note").otherwise("context")
    )
    hunked = lines.withColumn("kind", kind).withColumn("hunk", F.count_if(F.col("kind") == "header").over(so_far))

    def start(group: int) -> Column:
        found = F.regexp_extract("line", HUNK, group)
        return F.max(F.when(F.col("kind") == "header", found.try_cast("bigint"))).over(in_hunk)

    def before(kinds: tuple[str, ...]) -> Column:
        return F.count_if(F.col("kind").isin(*kinds)).over(in_hunk) - 1

    old, new = ("removed", "context"), ("added", "context")
    inside = hunked.filter("hunk > 0")
    return inside.select(
        *keys, "pos", "hunk", "kind", F.substr("line", F.lit(2)).alias("content"),
        F.when(F.col("kind").isin(*old), start(1) + before(old)).alias("old_lineno"),
        F.when(F.col("kind").isin(*new), start(3) + before(new)).alias("new_lineno"),
    )


def hunk_ranges(lines: DataFrame, keys: tuple[str, ...] = ("sha", "path")) -> DataFrame:
    """The four numbers of every hunk header; a missing count is 1."""
    def part(group: int) -> Column:
        found = F.regexp_extract("line", HUNK, group)
        return F.when(found == "", 1).otherwise(found.try_cast("bigint")).cast("bigint")

    return lines.filter(F.col("line").rlike(HUNK)).select(
        *keys, "pos", part(1).alias("old_start"), part(2).alias("old_count"), part(3).alias("new_start"),
        part(4).alias("new_count"),
    )


def cap_lines(lines: DataFrame, keys: tuple[str, ...] = ("sha", "path"), max_lines: int | None = None,
              max_bytes: int | None = None) -> DataFrame:
    """The kept lines of a file, numbered, with their whole number and whether some are left out.

    ``max_lines`` keeps the first so many (usual: 400), ``max_bytes`` replaces longer lines by a note of their
    size (usual: 2,000). Without them nothing is left out.
    """
    kept = lines.filter(F.col("line").rlike(HUNK) | F.left("line", F.lit(1)).isin("+", "-", "\\"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    size = F.octet_length("line")
    long = size > max_bytes if max_bytes is not None else F.lit(False)
    whole = kept.withColumn("n", nth).withColumn("n_lines", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    if max_lines is not None:
        whole = whole.filter(F.col("n") <= max_lines)
    note = F.concat(F.left("line", F.lit(1)), F.format_string("<line omitted: %d bytes>", size))
    cut = F.col("n_lines") > max_lines if max_lines is not None else F.lit(False)
    return whole.select(
        *keys, "n", F.when(long, note).otherwise(F.col("line")).alias("line"), long.alias("omitted"), "n_lines", cut.alias("truncated")
    )


def commit_budget(lines: DataFrame, budget: int) -> DataFrame:
    """How many lines of each file fit the commit's byte budget (usual: 200,000), files in order, of how many.

    ``lines(sha, file_no, n, line)``. A line over the remaining budget ends its own file only; later
    files go on with what is left. The fold runs over one record: a commit with its files.
    """
    sizes = lines.select("sha", "file_no", "n", (F.octet_length("line") + 1).cast("bigint").alias("size"))
    files = sizes.groupBy("sha", "file_no").agg(
        F.array_sort(F.collect_list(F.struct("n", "size"))).alias("sizes")
    )
    commits = files.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("file_no", "sizes"))).alias("files"))

    def take_line(state: Column, item: Column) -> Column:
        fits = ~state["stopped"] & (item["size"] <= state["left"])
        return F.struct(
            F.when(fits, state["left"] - item["size"]).otherwise(state["left"]).alias("left"),
            F.when(fits, state["kept"] + 1).otherwise(state["kept"]).alias("kept"),
            (~fits).alias("stopped"),
        )

    def take_file(state: Column, file: Column) -> Column:
        start = F.struct(state["left"].alias("left"), F.lit(0).cast("bigint").alias("kept"), F.lit(False).alias("stopped"))
        done = F.aggregate(file["sizes"], start, take_line)
        row = F.struct(file["file_no"].alias("file_no"), done["kept"].alias("kept"), done["stopped"].alias("truncated"), F.size(file["sizes"]).cast("bigint").alias("n_lines"))
        return F.struct(done["left"].alias("left"), F.concat(state["rows"], F.array(row)).alias("rows"))

    start = F.struct(
        F.lit(budget).cast("bigint").alias("left"),
        F.array().cast("array<struct<file_no:bigint,kept:bigint,truncated:boolean,n_lines:bigint>>").alias("rows"),
    )
    return commits.select("sha", F.explode(F.aggregate("files", start, take_file)["rows"]).alias("r")).select(
        "sha", "r.file_no", "r.kept", "r.truncated", "r.n_lines"
    )


def changed_line_kinds(numbered: DataFrame, keys: tuple[str, ...] = ("sha", "path"), path: str = "path",
                       pairing_max: int | None = None) -> DataFrame:
    """Blank, whitespace-only and comment lines of each file, added and removed.

    Within a hunk a removed line pairs with a later added one that is equal after squeezing: added
    lines without a partner are the highest excess of additions over removals on the way through the
    hunk. With ``pairing_max``, removed lines beyond so many per hunk do not take part (usual: 5,000).
    """
    markers = comment_markers(F.col(path))
    keep = indentation_matters(F.col(path))
    changed = numbered.filter(F.col("kind").isin("added", "removed")).select(
        *keys, "hunk", "pos", "kind", line_kind(F.col("content"), markers).alias("what"),
        squeeze(F.col("content"), keep).alias("text"),
    )
    removed = (F.col("kind") == "removed") & (F.col("what") != "blank")
    late = F.lit(False)
    if pairing_max is not None:
        nth = F.count_if(removed).over(Window.partitionBy(*keys, "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        late = removed & (nth > pairing_max)
    marked = changed.withColumn("pairable", (F.col("what") != "blank") & ~late)
    group = [*keys, "hunk", "text", "what", "pairable"]
    step = F.when(F.col("kind") == "added", 1).otherwise(-1)
    excess = F.sum(step).over(Window.partitionBy(*group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    sums = marked.withColumn("excess", excess).groupBy(*group).agg(
        F.count_if(F.col("kind") == "added").alias("a"), F.count_if(F.col("kind") == "removed").alias("r"),
        F.greatest(F.lit(0), F.max("excess")).alias("alone"),
    )
    paired = F.when(F.col("pairable"), F.col("a") - F.col("alone")).otherwise(0)
    is_comment = F.col("what") == "comment"
    zero = F.lit(0)
    return sums.withColumn("paired", paired).groupBy(*keys).agg(
        F.sum(F.when(F.col("what") == "blank", F.col("a")).otherwise(zero)).alias("blank_added"),
        F.sum(F.when(F.col("what") == "blank", F.col("r")).otherwise(zero)).alias("blank_removed"),
        F.sum("paired").alias("whitespace_only"),
        F.sum(F.when(is_comment, F.col("a") - F.col("paired")).otherwise(zero)).alias("comment_added"),
        F.sum(F.when(is_comment, F.col("r") - F.col("paired")).otherwise(zero)).alias("comment_removed"),
    )


def first_runs(numbered: DataFrame, keys: tuple[str, ...] = ("sha", "path"), limit: int | None = None) -> DataFrame:
    """The first unbroken run of added and of removed lines of every file, with ``limit`` its first so many lines (usual: 6)."""
    changed = numbered.filter(F.col("kind").isin("added", "removed"))
    order = Window.partitionBy(*keys, "kind").orderBy("pos")
    islands = changed.withColumn("nth", F.row_number().over(order)).withColumn("start", F.first("pos").over(order))
    run = islands.filter(F.col("pos") - F.col("nth") == F.col("start") - 1)
    if limit is not None:
        run = run.filter(F.col("nth") <= limit)
    lineno = F.when(F.col("kind") == "added", F.col("new_lineno")).otherwise(F.col("old_lineno"))
    return run.groupBy(*keys, "kind").agg(
        F.min(lineno).alias("line_start"), F.max(lineno).alias("line_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "content"))), lambda x: x["content"]), "\n")
        .alias("quote"),
    )


def latest_per_path(files: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The last row of each path in commit order."""
    row = F.struct(*[F.col(name) for name in files.columns])
    return files.groupBy(*key).agg(F.max_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def widest_per_path(files: DataFrame, key: tuple[str, ...], rank: str, order: tuple[str, ...]) -> DataFrame:
    """The row of the widest class per path: lowest rank, the first of equal ones."""
    row = F.struct(*[F.col(name) for name in files.columns])
    return files.groupBy(*key).agg(F.min_by(row, F.struct(rank, *order)).alias("_r")).select("_r.*")


def replay_origins(events: DataFrame) -> DataFrame:
    """Which commit wrote each line that a hunk removed, by replaying hunks in landing order.

    ``events(lineage, idx, sha, hunks)`` with hunks of (old_start, old_count, new_start, new_count) against
    the version before. Approximate where blame also looks through moves and white space. Rows stream
    through a task sorted by (lineage, idx); it holds the line owners of one file version at a time, never
    the history of a file.
    """
    schema = "lineage string, idx bigint, line bigint, origin_sha string"
    columns = ["lineage", "idx", "line", "origin_sha"]

    def replay(batches):
        current, owner = None, []
        for batch in batches:
            out = []
            for lineage, idx, sha, hunks in batch.itertuples(index=False):
                if lineage != current:
                    current, owner = lineage, []
                shift = 0
                for hunk in sorted(hunks, key=lambda h: h["old_start"]):
                    gone, come = hunk["old_count"], hunk["new_count"]
                    # A count of 0 names the line before an insertion.
                    at = hunk["old_start"] + shift - (1 if gone else 0)
                    out += [(lineage, idx, hunk["old_start"] + n, who) for n, who in enumerate(owner[at:at + gone])]
                    owner[at:at + gone] = [sha] * come
                    shift += come - gone
            yield pd.DataFrame(out, columns=columns)

    ordered = events.select("lineage", "idx", "sha", "hunks").repartition("lineage").sortWithinPartitions("lineage", "idx")
    return ordered.mapInPandas(replay, schema)
