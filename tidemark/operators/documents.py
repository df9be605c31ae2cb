"""A plain-text view of a commit for readers and models; it carries no outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip, let, path_words

# Fixed values.
BUDGET = 12_000
SECTION_BUDGET = 1_500
MESSAGE_BUDGET = 3_000
FILE_LIST_MAX = 60
SCOPES_SHOWN = 3
ENTITY_LIST_MAX = 20
TRUNCATION_MARK = "\n[truncated]"
SECTION_HEADINGS = (("why", "Why"), ("how", "How"), ("verify", "How it was verified"))
MIN_ROOM = 200


def _listed(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.array_join(values, ", ")).otherwise("none")


def _head(budget: int) -> Column:
    c, m = F.col("commit"), F.col("message")
    sha = m["revert"]["reverts_sha"]
    pr = m["revert"]["reverts_pr"]
    targets = F.concat_ws(
        ", ", F.when(F.coalesce(sha, F.lit("")) != "", F.concat(F.lit("commit "), F.left(sha, F.lit(12)))),
        F.when(pr.isNotNull(), F.concat(F.lit("PR #"), pr)),
    )
    entities = F.transform("areas.entities", lambda item: item["id"])
    more = F.when(
        F.size(entities) > ENTITY_LIST_MAX, F.concat(F.lit(" and "), F.size(entities) - ENTITY_LIST_MAX, F.lit(" more"))
    ).otherwise("")
    pointers = F.transform("submodules", lambda item: F.concat(
        F.lit("Submodule "), item["name"], F.lit(": "), F.left(F.coalesce(item["old_sha"], F.lit("added")), F.lit(12)), F.lit(" -> "),
        F.left(F.coalesce(item["new_sha"], F.lit("removed")), F.lit(12))))
    fixed = F.array_compact(F.array(
        F.concat(F.lit("Commit "), c["sha"], F.lit(" landed "), c["committed_at"]), F.concat(F.lit("Subject: "), m["subject"]),
        F.when(F.size(m["subject_tags"]) > 0, F.concat(F.lit("Tags: "), F.array_join(m["subject_tags"], ", "))),
        F.when(m["pr_number"].isNotNull(), F.concat(F.lit("PR: #"), m["pr_number"])),
        F.when(m["revert"]["is_revert"], F.concat(F.lit("Reverts: "), F.when(targets != "", targets).otherwise("unspecified"))),
    ))
    areas = F.array(
        F.concat(F.lit("Components: "), _listed(F.transform("areas.components", lambda item: item["id"]))),
        F.concat(F.lit("Feature areas: "), _listed(F.transform("areas.features", lambda item: item["id"]))),
        F.concat(F.lit("Entities: "), F.when(F.size(entities) > 0, F.concat(F.array_join(F.slice(entities, 1, ENTITY_LIST_MAX), ", "), more)).otherwise("none")),
    )
    sections = F.array_compact(F.array(*[
        F.when(F.coalesce(m["sections"][name], F.lit("")) != "", F.concat(F.lit(f"\n{title}:\n"), clip(m["sections"][name], SECTION_BUDGET)))
        for name, title in SECTION_HEADINGS
    ]))
    body = F.when(F.size(sections) > 0, sections).when(
        F.coalesce(m["body"], F.lit("")) != "", F.array(F.concat(F.lit("\nMessage:\n"), clip(m["body"], MESSAGE_BUDGET)))
    ).otherwise(F.array().cast("array<string>"))
    total = lambda name: F.aggregate(
        "files", F.lit(0).cast("bigint"), lambda acc, item: acc + F.coalesce(item[name], F.lit(0)))
    title = F.concat(F.lit("\nFiles ("), F.size("files"), F.lit(", +"), total("additions"), F.lit(" -"), total("deletions"), F.lit("):"))
    beyond = F.when(
        F.size("files") > FILE_LIST_MAX, F.array(F.concat(F.lit("... and "), F.size("files") - FILE_LIST_MAX, F.lit(" more files")))
    ).otherwise(F.array().cast("array<string>"))
    listed = F.transform(F.slice("files", 1, FILE_LIST_MAX), _file_line)
    return F.array_join(F.concat(fixed, pointers, areas, body, F.array(title), listed, beyond), "\n")


def _file_line(item: Column) -> Column:
    path = F.coalesce(item["new_path"], item["old_path"])
    moved = F.when(item["status"].isin("R", "C"), F.concat(F.lit(" (from "), item["old_path"], F.lit(")"))).otherwise("")
    size = F.when(item["binary"], "binary").otherwise(
        F.concat(F.lit("+"), F.coalesce(item["additions"], F.lit(0)), F.lit(" -"), F.coalesce(item["deletions"], F.lit(0))))
    count = F.size(item["scopes"])
    more = F.when(count > SCOPES_SHOWN, F.array(F.concat(F.lit("+"), count - SCOPES_SHOWN, F.lit(" more")))).otherwise(
        F.array().cast("array<string>"))
    where = F.when(count > 0, F.concat(F.lit(" in: "), F.array_join(F.concat(F.slice(item["scopes"], 1, SCOPES_SHOWN), more), " | "))).otherwise("")
    return F.concat(item["status"], F.lit(" "), F.rpad(item["file_class"], F.greatest(F.lit(9), F.length(item["file_class"])), F.lit(" ")),
                    F.lit(" "), path, moved, F.lit(" "), size, where)


def documents(records: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(sha, committed_at, chars, diff_complete, text) of nested commit records.

    Whole patch blocks are taken in file order while they fit; the first that does not is cut at a line
    if enough room is left, and ends the diff. The fold stays inside one record.
    """
    room = budget - len(TRUNCATION_MARK)
    title = "\n\nDiff (zero context):"
    blocks = F.transform(
        F.filter("files", lambda item: F.coalesce(item["patch"], F.lit("")) != ""),
        lambda item: F.concat(F.lit("\n--- "), F.coalesce(item["new_path"], item["old_path"]), F.lit("\n"), F.regexp_replace(item["patch"], r"\s+$", "")),
    )
    whole = ~F.exists("files", lambda item: F.coalesce(item["patch_truncated"], F.lit(False)))

    def take(state: Column, block: Column) -> Column:
        space = room - F.length(state["text"])
        fits = F.length(block) <= space
        cut = F.regexp_extract(F.left(block, space), r"(?s)^(.*)\n", 1)
        return F.when(state["open"], F.struct(
            F.when(fits, F.concat(state["text"], block)).when(space > MIN_ROOM, F.concat(state["text"], cut)).otherwise(state["text"]).alias("text"),
            fits.alias("open"), (state["complete"] & fits).alias("complete"),
        )).otherwise(state)

    def build(text: Column) -> Column:
        fits = F.length(text) + len(title) < room
        start = F.struct(F.concat(text, F.lit(title)).alias("text"), F.lit(True).alias("open"), F.col("_whole").alias("complete"))
        with_diff = F.when(fits, F.aggregate("_blocks", start, take)).otherwise(
            F.struct(text.alias("text"), F.lit(False).alias("open"), F.lit(False).alias("complete")))
        plain = F.struct(text.alias("text"), F.lit(True).alias("open"), F.col("_whole").alias("complete"))
        return F.when(F.size("_blocks") > 0, with_diff).otherwise(plain)

    built = records.withColumn("_whole", whole).withColumn("_blocks", blocks).withColumn("_head", _head(budget)).select(
        F.col("commit.sha").alias("sha"), F.col("commit.committed_at").alias("committed_at"), let(F.col("_head"), build).alias("d")
    )
    over = F.length("d.text") > budget
    complete = F.col("d.complete") & ~over
    text = F.when(over, F.left("d.text", F.lit(room))).otherwise(F.col("d.text"))
    marked = F.when(complete, text).otherwise(F.concat(text, F.lit(TRUNCATION_MARK)))
    return built.select("sha", "committed_at", F.length(marked).alias("chars"), complete.alias("diff_complete"), marked.alias("text"))


def commit_text(records: DataFrame, limit: int | None = MESSAGE_BUDGET) -> DataFrame:
    """(sha, text) for text similarity: subject, then the sections or else the first ``limit`` characters of the body (None: all), then the words of every path.

    A file that moved gives the words of its old path and of its new one.
    """
    m = F.col("message")
    sections = F.filter(F.map_values(m["sections"]), lambda text: F.coalesce(text, F.lit("")) != "")
    body = F.coalesce(m["body"], F.lit(""))
    prose = F.when(F.size(sections) > 0, sections).otherwise(F.array(body if limit is None else F.left(body, F.lit(limit))))
    paths = F.flatten(F.transform("files", lambda item: F.array_distinct(F.array_compact(F.array(item["old_path"], item["new_path"])))))
    return records.select(F.col("commit.sha").alias("sha"), F.array_join(F.concat(F.array(F.coalesce(m["subject"], F.lit(""))), prose, F.transform(paths, path_words)), "\n").alias("text"))


def commit_items(records: DataFrame) -> DataFrame:
    """(sha, item), distinct: the files of a commit by either path, its components, feature areas and entities."""
    named = lambda kind, values: F.transform(values, lambda value: F.concat(F.lit(f"{kind}:"), value))
    ids = lambda name: F.transform(f"areas.{name}", lambda item: item["id"])
    paths = F.flatten(F.transform("files", lambda item: F.array_compact(F.array(item["old_path"], item["new_path"]))))
    every = F.concat(named("file", paths), named("component", ids("components")), named("feature", ids("features")), named("entity", ids("entities")))
    return records.select(F.col("commit.sha").alias("sha"), F.explode(F.array_distinct(every)).alias("item")).distinct()
