"""Outcome labels. Each one depends on later commits, carries the time of its event, and is never a feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .history import DAY

# Fixed values.
REVERT_WINDOWS_DAYS = (7, 30, 90)
TRIVIAL_LINE = r"^[{}()\[\];,]*$"
COMMENT_PREFIXES = ("//", "/*", "*/", "* ", "# ", "--")
LABELS = ("bug_introducing", "reverted", *(f"reverted_within_{days}d" for days in REVERT_WINDOWS_DAYS))


def resolve_reverts(commits: DataFrame) -> DataFrame:
    """Every revert with the commit it undoes: by key if that is older, else by the PR's first commit."""
    reverts = commits.filter("is_revert").select(
        F.col("idx").alias("revert"), F.col("reverts_sha"), F.col("reverts_pr")
    )
    by_key = commits.select(F.col("sha").alias("reverts_sha"), F.col("idx").alias("_by_key"))
    by_pr = commits.filter("pr_number is not null").groupBy(F.col("pr_number").alias("reverts_pr")).agg(
        F.min("idx").alias("_by_pr")
    )
    key = F.when(F.col("_by_key") < F.col("revert"), F.col("_by_key"))
    pr = F.when(F.col("_by_pr") < F.col("revert"), F.col("_by_pr"))
    return (
        reverts.join(by_key, "reverts_sha", "left").join(by_pr, "reverts_pr", "left")
        .select("revert", F.coalesce(key, pr).alias("target"),
                F.when(key.isNotNull(), "sha").when(pr.isNotNull(), "pr").alias("method"))
    )


def link_reverts(commits: DataFrame) -> DataFrame:
    """One row per reverted commit: its earliest revert, how it was found, and whether it is nested."""
    earliest = (
        resolve_reverts(commits).filter("target is not null").groupBy("target")
        .agg(F.min_by(F.struct("revert", "method"), "revert").alias("link"))
        .select("target", "link.revert", "link.method")
    )
    return earliest.join(
        commits.select(F.col("idx").alias("target"), F.col("is_revert").alias("nested")), "target"
    )


def revert_stats(commits: DataFrame) -> DataFrame:
    resolved = resolve_reverts(commits).join(
        commits.select(F.col("idx").alias("target"), F.col("is_revert").alias("nested")), "target", "left"
    )
    return resolved.agg(
        F.count(F.lit(1)).alias("reverts"),
        F.count_if(F.col("method") == "sha").alias("linked_by_sha"),
        F.count_if(F.col("method") == "pr").alias("linked_by_pr"),
        F.count_if(F.col("method").isNull()).alias("unlinked"),
        F.count_if(F.col("nested")).alias("nested"),
    )


def is_meaningful_line(text: Column) -> Column:
    """False for blank, bracket-only and comment lines."""
    def meaningful(stripped: Column) -> Column:
        comment = stripped == "#"
        for prefix in COMMENT_PREFIXES:
            comment = comment | stripped.startswith(prefix)
        return ~(stripped.rlike(TRIVIAL_LINE) | comment)

    # An array of one: a filter splits the tests and would strip the line anew for each.
    return F.forall(F.array(F.regexp_replace(text, r"^\s+|\s+$", "")), meaningful)


def blame_targets(files: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """Eligibility, deleted-line ranges and deleted-line sum per commit from files with hunks.

    ``files(sha, old_path, file_class, binary, hunks)``; a hunk is (old_start, old_count, ..).
    """
    usable = F.col("file_class").isin(*classes) & ~F.col("binary")
    ranges = (
        files.filter(usable & F.col("old_path").isNotNull())
        .select("sha", "old_path", F.explode("hunks").alias("h")).filter("h.old_count > 0")
        .groupBy("sha").agg(F.sum("h.old_count").alias("szz_deleted_lines"), F.count(F.lit(1)).alias("n_ranges"))
    )
    eligible = files.groupBy("sha").agg(F.bool_or(usable).alias("szz_eligible"))
    return eligible.join(ranges, "sha", "left").na.fill(0, ["szz_deleted_lines", "n_ranges"])


def attribute_bugs(
    fixes: DataFrame, targets: DataFrame, line_origin: DataFrame, commits: DataFrame,
    max_deleted: int | None = None,
) -> DataFrame:
    """(introducer, fix, deleted) pairs, one per blamed line that an older commit of the chain wrote.

    ``fixes(idx, parent)`` are fix-like commits with a parent, ``targets(idx, path, range_start,
    range_end)`` the lines each removed, ``line_origin(parent, path, line, origin_sha, text)`` who wrote
    the lines of the parent tree. ``deleted`` is the number of lines that the fix removed; with ``max_deleted``
    fixes over it are left out (the usual bound is 1,000). The line table travels once, so pass no more of it than the parent trees of fixes.
    """
    width = F.col("range_end") - F.col("range_start") + 1
    targets = targets.join(fixes.select("idx"), "idx", "left_semi")
    deleted = targets.groupBy("idx").agg(F.sum(width).cast("bigint").alias("deleted"))
    sized = targets.join(fixes, "idx").join(deleted, "idx")
    if max_deleted is not None:
        sized = sized.filter(F.col("deleted") <= max_deleted)
    lines = sized.select(F.col("idx").alias("fix"), "parent", "path", "deleted", F.explode(F.sequence("range_start", "range_end")).alias("line"))
    written = line_origin.filter(is_meaningful_line(F.col("text"))).select("parent", "path", "line", "origin_sha")
    return (
        lines.join(written, ["parent", "path", "line"])
        .join(commits.select(F.col("sha").alias("origin_sha"), F.col("idx").alias("introducer")), "origin_sha")
        .filter("introducer < fix").select("introducer", "fix", "deleted")
    )


def introducers(pairs: DataFrame) -> DataFrame:
    """The earliest fix and the number of distinct fixes of each introducing commit."""
    return pairs.groupBy("introducer").agg(
        F.min("fix").alias("fix"), F.count_distinct("fix").alias("fix_count")
    )


def commit_labels(facts: DataFrame, links: DataFrame, bugs: DataFrame | None) -> DataFrame:
    """Labels as of the snapshot. Null means unknown: merges, and for bugs also ineligible commits."""
    times = facts.select(F.col("idx").alias("_i"), F.col("sha").alias("_s"), F.col("landed").alias("_l"))
    reverts = links.join(times, F.col("revert") == F.col("_i")).select(
        F.col("target").alias("idx"), F.col("_s").alias("reverted_by"), F.col("_l").alias("reverted_landed"),
        F.col("method").alias("revert_link"), F.col("nested"),
    )
    labelled = facts.join(reverts, "idx", "left")
    known = ~F.col("is_merge")
    lead = (F.col("reverted_landed") - F.col("landed")) / DAY
    hit = F.col("reverted_landed").isNotNull()
    columns = [
        F.when(known, hit).alias("reverted"),
        *[F.when(known, F.col(name)).alias(name) for name in ("reverted_by", "reverted_landed", "revert_link")],
        F.when(known, F.round(lead, 3)).alias("revert_lead_days"),
        F.when(known, F.coalesce("nested", F.lit(False))).alias("revert_nested"),
        *[F.when(known, F.coalesce(lead <= days, F.lit(False))).alias(f"reverted_within_{days}d")
          for days in REVERT_WINDOWS_DAYS],
    ]
    if bugs is None:
        nothing = F.lit(None)
        return labelled.select(
            "idx", "sha", "landed", *columns, nothing.cast("boolean").alias("bug_introducing"),
            nothing.cast("bigint").alias("fixed_landed"), nothing.cast("double").alias("fix_lead_days"),
            nothing.cast("bigint").alias("fix_count"),
        )
    fixes = bugs.join(times, F.col("fix") == F.col("_i")).select(
        F.col("introducer").alias("idx"), F.col("_l").alias("fixed_landed"), "fix_count"
    )
    known_bug = known & ~F.col("submodule_only") & F.col("szz_eligible")
    return labelled.join(fixes, "idx", "left").select(
        "idx", "sha", "landed", *columns,
        F.when(known_bug, F.col("fixed_landed").isNotNull()).alias("bug_introducing"),
        F.when(known_bug, F.col("fixed_landed")).alias("fixed_landed"),
        F.when(known_bug, F.round((F.col("fixed_landed") - F.col("landed")) / DAY, 3)).alias("fix_lead_days"),
        F.when(known_bug, F.coalesce("fix_count", F.lit(0))).alias("fix_count"),
    )


def split_labels(labels: DataFrame, ends: DataFrame) -> DataFrame:
    """Labels as known when the row's split ended. ``labels`` carries ``split``; ``ends(split, end)``."""
    seen = labels.join(ends, "split", "left")
    inside = lambda flag, at: F.when(
        F.col("end").isNotNull() & F.col(flag), F.col(at) <= F.col("end")
    ).otherwise(F.col(flag))
    seen = seen.withColumn("_r", inside("reverted", "reverted_landed")).withColumn(
        "_b", inside("bug_introducing", "fixed_landed")
    )
    windows = {
        f"reverted_within_{days}d": F.when(F.col(f"reverted_within_{days}d"), F.coalesce("_r", F.lit(False)))
        .otherwise(F.col(f"reverted_within_{days}d")) for days in REVERT_WINDOWS_DAYS
    }
    return seen.withColumns({**windows, "reverted": F.col("_r"), "bug_introducing": F.col("_b")}).drop("_r", "_b", "end")


def positive_rates(labels: DataFrame, group: str = "split") -> DataFrame:
    """Positive, known and rate per group and label."""
    long = labels.unpivot([group], list(LABELS), "label", "value").filter("value is not null")
    return long.groupBy(group, "label").agg(
        F.count_if("value").alias("positive"), F.count(F.lit(1)).alias("known"),
        F.round(F.avg(F.col("value").cast("double")), 6).alias("rate"),
    )
