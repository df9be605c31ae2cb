"""Backtest corpus: incidents and their causes, funnels, controls, ground truth and grading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PR_SUFFIX, REVERTS_SHA, number
from ..session import checkpointed
from .metrics import rate, upper_median
from .splits import prefix_pairs, resolve_prefixes

# Fixed values.
NESTED_REVERT = r'^Revert\s+"Revert'
QUOTED_SUBJECT = r'^Revert\s+"(.+)"'
REVERT_WORD = r"(?i)\brevert"
TAG_ONLY = ("delta", "fs", "nexthop", "virtual", "vs")
LEVELS = ("platform", "family", "vendor")
READINGS = {"string_equality": ("uncovered", "ambiguous"), "architecture_aware": ("uncovered",)}


def patch_overlap(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Local-only commits that share paths with the incoming change, with the number of shared paths."""
    shared = local.select("sha", "path").distinct().join(incoming.select("path").distinct(), "path", "left_semi")
    return shared.groupBy("sha").agg(F.count(F.lit(1)).alias("shared"))


def mine_incidents(reverts: DataFrame, commits: DataFrame) -> DataFrame:
    """Every revert with its cause: unlinked without a trailer, unresolved without the commit, else linked.

    ``reverts(sha, subject, body, committed_epoch)``, ``commits(sha, committed_epoch)``. Trailers may name a
    unique prefix of a key.
    """
    named = F.regexp_extract_all("body", F.lit(REVERTS_SHA), 1)
    found = reverts.withColumn("named", named).withColumn("prefix", F.get("named", 0))
    keys = resolve_prefixes(commits, "sha", found.filter("prefix is not null").select("prefix"))
    causes = keys.filter("key is not null").select("prefix", F.col("key").alias("cause_sha")).join(
        commits.select(F.col("sha").alias("cause_sha"), F.col("committed_epoch").alias("cause_epoch")), "cause_sha"
    )
    row = found.join(causes, "prefix", "left")
    return row.select(
        F.col("sha").alias("revert_sha"), F.col("subject").alias("revert_subject"),
        F.col("committed_epoch").alias("revert_epoch"), number(F.regexp_extract("subject", PR_SUFFIX, 1)).alias("pr_number"),
        F.col("subject").rlike(NESTED_REVERT).alias("is_nested"),
        F.when(F.col("prefix").isNull(), "unlinked").when(F.col("cause_sha").isNull(), "unresolved").otherwise("linked").alias("link_status"),
        F.coalesce("cause_sha", "prefix").alias("reverted_sha"), F.col("cause_epoch"),
        F.greatest(F.size("named") - 1, F.lit(0)).cast("bigint").alias("n_additional"),
        F.floor((F.col("committed_epoch") - F.col("cause_epoch")) / 86400).alias("lead_time_days"),
    )


def summarize_incidents(incidents: DataFrame) -> DataFrame:
    """Status counts and lead times; the median is the upper of two middle values."""
    counts = incidents.agg(
        F.count(F.lit(1)).alias("reverts"),
        *[F.count_if(F.col("link_status") == name).alias(name) for name in ("linked", "unlinked", "unresolved")],
        F.count_if("is_nested").alias("nested_reverts"), F.count("pr_number").alias("with_pr_number"),
        F.count("lead_time_days").alias("lead_count"), F.count_if(F.col("lead_time_days") < 0).alias("lead_negative"),
        F.min("lead_time_days").alias("lead_min"), F.max("lead_time_days").alias("lead_max"),
    )
    middle = upper_median(incidents, "lead_time_days").withColumn("_one", F.lit(1))
    return counts.withColumn("_one", F.lit(1)).join(middle, "_one", "left").drop("_one").withColumnRenamed("median", "lead_median")


def funnel(candidates: DataFrame) -> DataFrame:
    """The step that drops each candidate; ``pool`` for those that pass all.

    Columns: link_status, on_chain, is_nested, touched, named, analyzable, gradeable.
    """
    step = (
        F.when(F.col("link_status") == "unlinked", "unlinked")
        .when((F.col("link_status") == "unresolved") | ~F.col("on_chain"), "unresolved")
        .when(F.col("is_nested"), "nested")
        .when((F.col("touched") == 0) & (F.col("named") == 0), "irrelevant")
        .when(~F.col("analyzable"), "outside_domain")
        .when(~F.col("gradeable"), "ungradeable").otherwise("pool")
    )
    return candidates.withColumn("step", step)


def most_recent(pool: DataFrame, n: int, when: str = "revert_epoch", tie: str = "revert_sha") -> DataFrame:
    """The ``n`` newest, ties by key; fewer when the pool is smaller."""
    return pool.orderBy(F.desc(when), F.asc(tie)).limit(n)


def funnel_counts(rows: DataFrame, requested: int) -> DataFrame:
    """Totals of each step of the funnel and what follows from them."""
    is_ = lambda *names: F.count_if(F.col("step").isin(*names))
    relevant = F.count_if(F.col("step").isin("outside_domain", "ungradeable", "pool"))
    with_trailer = F.count_if(F.col("link_status") != "unlinked")
    return rows.agg(
        F.count(F.lit(1)).alias("reverts_mined"), with_trailer.alias("with_trailer"), is_("unlinked").alias("without_trailer"),
        is_("unresolved").alias("trailer_not_on_chain"), (with_trailer - is_("unresolved")).alias("linked_on_chain"),
        is_("nested").alias("nested_excluded"), F.count_if("is_nested").alias("nested_total"),
        (with_trailer - is_("unresolved") - is_("nested")).alias("eligible"), is_("irrelevant").alias("irrelevant"),
        relevant.alias("relevant"),
        F.count_if(F.col("step").isin("outside_domain", "ungradeable", "pool") & (F.col("touched") > 0)).alias("relevant_by_path"),
        is_("outside_domain").alias("outside_domain"), is_("ungradeable").alias("ungradeable"), is_("pool").alias("pool"),
        F.greatest(F.lit(0).cast("bigint"), F.lit(requested) - is_("pool")).alias("shortfall"),
    )


def quoted_matches(commits: DataFrame, quoted: DataFrame) -> DataFrame:
    """Keys of commits whose subject a revert quotes, whole or cut short by an ellipsis.

    Cut quotes join on the head of the subject (``prefix_pairs``). ``quoted(text)``.
    """
    whole = commits.join(quoted.select(F.col("text").alias("subject")), "subject", "left_semi").select("sha")
    cut = checkpointed(quoted.filter(F.col("text").endswith("…")).select(F.expr("left(text, length(text) - 1)").alias("prefix")).distinct())
    return whole.union(prefix_pairs(commits.select("sha", "subject"), "subject", cut).select("sha")).distinct()


def screen_controls(commits: DataFrame, reverted: DataFrame, quoted: DataFrame, paths: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Each commit with the reason it cannot be a control, or ``pool``.

    ``commits(sha, subject, n_parents)``, ``reverted(sha)`` named by trailers, ``quoted(text)`` of unlinked
    reverts, ``paths(sha, path)``.
    """
    named = reverted.select("sha").distinct().withColumn("_named", F.lit(True))
    shown = quoted_matches(commits, quoted).withColumn("_quoted", F.lit(True))
    under = F.lit(False)
    for root in roots:
        under = under | F.col("path").startswith(root)
    touching = paths.filter(under).select("sha").distinct().withColumn("_touches", F.lit(True))
    row = commits.join(named, "sha", "left").join(shown, "sha", "left").join(touching, "sha", "left")
    return row.select(
        "sha",
        F.when(F.col("n_parents") != 1, "merge").when(F.col("subject").rlike(REVERT_WORD), "revert_itself")
        .when(F.col("_named"), "named_by_revert_trailer").when(F.col("_quoted"), "quoted_by_unlinked_revert")
        .when(F.col("_touches").isNull(), "not_touching_roots").otherwise("pool").alias("screen"),
    )


def rank_key(salt: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(salt + ":"), key.cast("string")), 256)


def hash_sample(pool: DataFrame, salt: str, quota: int, usable: Column | None = None, key: str = "sha") -> DataFrame:
    """The first ``quota`` usable rows in ascending hash order, with every row examined on the way.

    The last taken row marks how far the walk went; rows beyond it were never looked at.
    """
    ranked = checkpointed(pool.withColumn("rank_key", rank_key(salt, F.col(key))).withColumn(
        "usable", F.lit(True) if usable is None else usable
    ))
    taken = ranked.filter("usable").orderBy("rank_key", key).limit(quota)
    last = taken.agg(F.when(F.count(F.lit(1)) == quota, F.max("rank_key"))).scalar()
    return ranked.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col("rank_key") <= F.col("_last"))).drop("_last")


def mentions(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, kind, entity, via) of vocabulary names in texts: whole words, or parts of a [tag].

    A hyphen and an underscore belong to a word. Names meet the words of texts by equality on the longest word of the
    name, which settles names of one word; only for the others is the text looked up again and the full name
    checked in place. ``texts(id, text)``, ``vocabulary(kind, entity, name)``.
    """
    low = texts.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    names = vocabulary.select("kind", "entity", F.lower("name").alias("name")).distinct()
    tags = F.transform(F.regexp_extract_all("text", F.lit(r"\[([^\]]+)\]"), 1), lambda tag: F.trim(tag))
    pieces = F.flatten(F.transform(tags, lambda tag: F.concat(F.array(tag), F.split(tag, "[^a-z0-9_.-]+"))))
    tagged = low.select("id", F.explode(F.array_distinct(pieces)).alias("name")).filter("name <> ''").join(names, "name")
    words = F.regexp_extract_all("name", F.lit("[a-z0-9_-]+"), 0)
    longest = F.aggregate(words, F.lit(""), lambda best, word: F.when(F.length(word) > F.length(best), word).otherwise(best))
    keyed = names.filter(~F.col("name").isin(*TAG_ONLY)).withColumn("word", longest).filter("word <> ''")
    spelled = F.concat(F.lit(r"(?<![a-z0-9_-])\Q"), "name", F.lit(r"\E(?![a-z0-9_-])"))
    met = low.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z0-9_-]+"), 0))).alias("word")).join(keyed, "word")
    longer = met.filter("name <> word").join(low, "id").filter(F.call_function("rlike", "text", spelled))
    whole = met.filter("name = word").select("id", "kind", "entity").union(longer.select("id", "kind", "entity"))
    found = tagged.select("id", "kind", "entity", F.lit("subject_tag").alias("via")).unionByName(
        whole.select("id", "kind", "entity", F.lit("subject").alias("via"))
    )
    return found.groupBy("id", "kind", "entity").agg(F.max("via").alias("via"))


def evidence(
    subjects: DataFrame, paths: DataFrame, vocabulary: DataFrame, shared: DataFrame, entity_root: str = "device",
    family_root: str = "platform",
) -> tuple[DataFrame, DataFrame]:
    """(direct, linked): what reverts touch or name themselves, and the shared directories that they touch.

    ``direct(id, kind, entity, path, o, via)`` has the first evidence of each entity, ``linked(id, directory, path)`` the first path
    in each directory of ``shared``. Every entity of such a directory is touched too; as they may be very many, they are not listed here.
    """
    part = F.split("path", "/")
    distinct = paths.select("id", "path").distinct()
    deep = distinct.filter((F.size(part) >= 4) & (part[0] == entity_root)).select(
        "id", "path", F.concat_ws("/", part[1], part[2]).alias("entity"), F.array_join(F.slice(part, 1, 3), "/").alias("directory")
    )
    platforms = vocabulary.filter("kind = 'platform'").select("entity").distinct()
    families = vocabulary.filter("kind = 'family'").select("entity").distinct()
    own = deep.join(platforms, "entity").select("id", F.lit("platform").alias("kind"), "entity", "path", F.lit(0).alias("o"), F.lit("path").alias("via"))
    family = distinct.filter((F.size(part) >= 3) & (part[0] == family_root)).select("id", "path", part[1].alias("entity")).join(
        families, "entity").select("id", F.lit("family"), "entity", "path", F.lit(0), F.lit("family_path"))
    spoken = mentions(subjects.select("id", F.col("subject").alias("text")), vocabulary).select(
        "id", "kind", "entity", F.lit(None).cast("string"), F.lit(2), "via")
    linked = deep.join(shared.select("directory").distinct(), "directory", "left_semi").groupBy("id", "directory").agg(F.min("path").alias("path"))
    return _first_evidence(own.union(family).union(spoken)), linked


def _first_evidence(rows: DataFrame) -> DataFrame:
    """The first row of each (id, kind, entity): paths in order, own directories before shared ones, then the subject."""
    first = F.struct(F.col("path").isNull(), F.col("path"), F.col("o"), F.col("via"))
    return rows.groupBy("id", "kind", "entity").agg(F.min_by(F.struct("path", "o", "via"), first).alias("e")).select("id", "kind", "entity", "e.*")


# A directory's entities are dealt in lists of so many, and the rows that touch it over so many join keys.
LIST, SPREAD = 256, 64


def ground_truth(
    subjects: DataFrame, paths: DataFrame, vocabulary: DataFrame, shared: DataFrame, entity_root: str = "device",
    family_root: str = "platform",
) -> DataFrame:
    """(id, kind, entity, via, detail): what a revert touches or names, with its first evidence.

    Evidence order: paths in order (own directory before shared ones), then the subject.
    ``shared(directory, entity)`` are entities that link into a shared directory. The result has a row for each of them, but
    they are listed last: only the (id, directory) pairs are shuffled, with the few entities that have other evidence beside them.
    """
    direct, linked = (checkpointed(rows) for rows in evidence(subjects, paths, vocabulary, shared, entity_root, family_root))
    links = checkpointed(shared.select("directory", "entity").distinct())
    several = links.groupBy("entity").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("entity")
    cols = ["id", "kind", "entity", "path", "o", "via"]
    as_evidence = lambda rows: rows.select("id", F.lit("platform").alias("kind"), "entity", "path", F.lit(1).alias("o"), F.lit("shared_path").alias("via"))
    # Entities with direct evidence, and those of several directories, are settled by key; all others have this one directory only.
    both = checkpointed(as_evidence(direct.filter("kind = 'platform'").select("id", "entity").join(links, "entity").join(linked, ["id", "directory"])))
    many = as_evidence(linked.join(links.join(several, "entity", "left_semi"), "directory"))
    keyed = _first_evidence(direct.select(cols).union(both).union(many))
    known = both.groupBy("id").agg(F.collect_set("entity").alias("_known"))
    lists = links.join(several, "entity", "left_anti").groupBy("directory", F.pmod(F.xxhash64("entity"), F.lit(1 << 20)).alias("_at")).agg(
        F.collect_list("entity").alias("entities"))
    packed = lists.groupBy("directory", (F.col("_at") % _parts(links)).alias("_list")).agg(F.flatten(F.collect_list("entities")).alias("entities"))
    dealt = packed.select("directory", "entities", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_salt"))
    rows = linked.join(known, "id", "left").withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int"))
    listed = rows.join(dealt, ["directory", "_salt"]).select("id", "path", F.explode(
        F.when(F.col("_known").isNull(), F.col("entities")).otherwise(F.array_except("entities", "_known"))).alias("entity"))
    return keyed.union(as_evidence(listed)).select("id", "kind", "entity", "via", F.col("path").alias("detail"))


def _parts(links: DataFrame) -> Column:
    """In how many lists the largest directory is cut."""
    largest = links.groupBy("directory").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    return F.lit(largest // LIST + 1)


def landing(truth: DataFrame, families: DataFrame, platforms: DataFrame) -> DataFrame:
    """(id, platform) a revert lands on: named platforms and members of named families, vendors only otherwise.

    ``families(platform, family)``, ``platforms(platform, vendor)``.
    """
    own = truth.filter("kind = 'platform'").select("id", F.col("entity").alias("platform"))
    member = truth.filter("kind = 'family'").select("id", F.col("entity").alias("family")).join(families, "family").select("id", "platform")
    fine = own.union(member).join(platforms.select("platform"), "platform", "left_semi").select("id", "platform").distinct()
    coarse = truth.filter("kind = 'vendor'").select("id", F.col("entity").alias("vendor")).join(
        fine.select("id").distinct(), "id", "left_anti").join(platforms, "vendor").select("id", "platform")
    return fine.union(coarse).distinct()


def landing_rates(landed: DataFrame, status: DataFrame) -> DataFrame:
    """Where each revert landed relative to coverage, under both readings."""
    row = landed.join(status, "platform", "left")
    u, a, n = F.count_if(F.col("status") == "uncovered"), F.count_if(F.col("status") == "ambiguous"), F.count(F.lit(1))
    return _shares(row.groupBy("id").agg(n.alias("landed"), u.alias("landed_uncovered"), a.alias("landed_ambiguous")))


def _shares(counts: DataFrame) -> DataFrame:
    u, a, n = (F.col(name) for name in ("landed_uncovered", "landed_ambiguous", "landed"))
    return counts.select(
        "id", "landed", "landed_uncovered", "landed_ambiguous", ((u + a) > 0).alias("any_never_built"),
        (u > 0).alias("any_uncovered"), F.round((u + a) / n, 6).alias("share_never_built"), F.round(u / n, 6).alias("share_uncovered"),
    )


def landing_rates_of(
    direct: DataFrame, linked: DataFrame, shared: DataFrame, families: DataFrame, platforms: DataFrame, status: DataFrame
) -> DataFrame:
    """``landing_rates`` over ``landing`` from the parts of ``evidence``, without listing the platforms of directories, families and vendors.

    Platforms of the same directories and families form a class; a revert adds up the sizes of the classes it meets, each once, and the
    platforms it names outside them. Work grows with the classes met, of which there are never more than platforms.
    """
    known = platforms.select("platform").distinct()
    counts = known.join(status, "platform", "left").groupBy("platform").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "uncovered").alias("u"), F.count_if(F.col("status") == "ambiguous").alias("a"))
    counts = checkpointed(counts)
    kind = lambda name: direct.filter(F.col("kind") == name)
    group = lambda name, column: F.concat(F.lit(name + ":"), column).alias("group")
    fine = _union_counts(
        kind("family").select("id", group("family", F.col("entity"))).union(linked.select("id", group("directory", F.col("directory")))),
        kind("platform").select("id", F.col("entity").alias("platform")),
        shared.select(F.col("entity").alias("platform"), group("directory", F.col("directory"))).union(families.select("platform", group("family", F.col("family")))), counts)
    fine = checkpointed(fine)
    named = kind("vendor").join(fine.select("id"), "id", "left_anti").select("id", group("vendor", F.col("entity")))
    coarse = _union_counts(named, None, platforms.select("platform", group("vendor", F.col("vendor"))), counts)
    return _shares(fine.union(coarse))


def _union_counts(met: DataFrame, single: DataFrame | None, members: DataFrame, counts: DataFrame) -> DataFrame:
    """Sums of ``counts(platform, n, u, a)`` over the union of the groups ``met(id, group)`` and the platforms ``single(id, platform)``."""
    classed = members.join(counts.select("platform"), "platform", "left_semi").groupBy("platform").agg(F.array_sort(F.collect_set("group")).alias("class"))
    classed = checkpointed(classed)
    sums = classed.join(counts, "platform").groupBy("class").agg(*[F.sum(name).alias(name) for name in ("n", "u", "a")])
    within = sums.select(F.sha2(F.to_json("class"), 256).alias("class"), F.explode("class").alias("group"), "n", "u", "a")
    found = met.distinct().join(within, "group").groupBy("id", "class").agg(*[F.first(name).alias(name) for name in ("n", "u", "a")])
    if single is not None:
        found = checkpointed(found)
        alone = single.distinct().join(counts, "platform").join(classed.select("platform", F.sha2(F.to_json("class"), 256).alias("class")), "platform", "left")
        found = found.select("id", "n", "u", "a").union(alone.join(found.select("id", "class"), ["id", "class"], "left_anti").select("id", "n", "u", "a"))
    return found.groupBy("id").agg(F.sum("n").alias("landed"), F.sum("u").alias("landed_uncovered"), F.sum("a").alias("landed_ambiguous"))


def match(
    truth: DataFrame, flagged: DataFrame, families: DataFrame, platforms: DataFrame, linked: DataFrame | None = None,
    shared: DataFrame | None = None,
) -> DataFrame:
    """(id, flagged, entity, level) hits: by platform, by declared family, by vendor only when nothing finer is named.

    ``truth`` is that of ``ground_truth``, or the direct part of ``evidence`` with ``linked`` and ``shared`` beside it: then only the
    flagged platforms are looked up in the directories, and their other entities are never listed.
    """
    kind = lambda name: truth.filter(F.col("kind") == name).select("id", F.col("entity"))
    fine = truth.filter("kind in ('platform', 'family')").select("id")
    cell = flagged.select("id", "platform").distinct()
    exact = cell.withColumn("entity", F.col("platform")).join(kind("platform"), ["id", "entity"]).withColumn("level", F.lit("platform"))
    columns = ["id", "platform", "entity", "level"]
    if linked is not None:
        fine = fine.union(linked.select("id"))
        reached = cell.join(shared.select(F.col("entity").alias("platform"), "directory").distinct(), "platform").join(linked.select("id", "directory"), ["id", "directory"])
        exact = exact.select(columns).union(reached.select("id", "platform", F.col("platform").alias("entity"), F.lit("platform").alias("level")))
    family = cell.join(families.select("platform", F.col("family").alias("entity")), "platform").join(
        kind("family"), ["id", "entity"]).withColumn("level", F.lit("family"))
    vendor = cell.join(platforms.select("platform", F.col("vendor").alias("entity")), "platform").join(
        kind("vendor").join(fine.distinct(), "id", "left_anti"), ["id", "entity"]).withColumn("level", F.lit("vendor"))
    return exact.select(columns).union(family.select(columns)).union(vendor.select(columns)).distinct()


def grade_items(
    items: DataFrame, coverage: DataFrame, truth: DataFrame, families: DataFrame, platforms: DataFrame, linked: DataFrame | None = None,
    shared: DataFrame | None = None,
) -> DataFrame:
    """One row per item and reading: how many entities it flags, whether it recalls, at which level.

    ``items(id, kind)``, ``coverage(id, platform, status)``; ``truth``, ``linked`` and ``shared`` as in ``match``. A hit depends on its
    platform alone, so all flagged platforms are matched once and each reading takes its own.
    """
    cells = coverage.filter(F.col("status").isin(*{name for names in READINGS.values() for name in names})).select("id", "platform", "status").distinct()
    rank = F.min(F.when(F.col("level") == "platform", 0).when(F.col("level") == "family", 1).otherwise(2))
    levels = match(truth, cells, families, platforms, linked, shared).groupBy("id", "platform").agg(rank.alias("_l"))
    row = cells.join(levels, ["id", "platform"], "left")
    per_item = checkpointed(row.groupBy("id").agg(*[
        value for at, statuses in enumerate(READINGS.values()) for value in (
            F.count_distinct(F.when(F.col("status").isin(*statuses), F.col("platform"))).alias(f"_f{at}"),
            F.min(F.when(F.col("status").isin(*statuses), F.col("_l"))).alias(f"_l{at}"))
    ]))
    rows = None
    for at, reading in enumerate(READINGS):
        part = items.join(per_item, "id", "left").select(
            "id", "kind", F.lit(reading).alias("reading"), F.coalesce(f"_f{at}", F.lit(0)).cast("bigint").alias("flagged"),
            F.col(f"_l{at}").isNotNull().alias("recalled"), F.get(F.array(*[F.lit(name) for name in LEVELS]), F.col(f"_l{at}")).alias("level"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


def backtest_rates(graded: DataFrame) -> DataFrame:
    """Recall, control flag rate and precision per reading, with Wilson intervals."""
    incident, flagged = F.col("kind") == "incident", F.col("flagged") > 0
    sums = graded.groupBy("reading").agg(
        F.count_if(incident & F.col("recalled")).alias("r"), F.count_if(incident).alias("i"),
        F.count_if(~incident & flagged).alias("c"), F.count_if(~incident).alias("n"), F.count_if(flagged).alias("p"),
    )
    col = F.col
    return sums.select("reading", *rate(col("r"), col("i"), "recall"), *rate(col("c"), col("n"), "control_flag"), *rate(col("r"), col("p"), "precision"))


def submodule_names(gitlinks: DataFrame, modules: DataFrame, parents: DataFrame) -> DataFrame:
    """Name and URL of each moved pointer: the commit's own module table, else its first parent's, else the path."""
    own = modules.select("sha", "path", F.col("name").alias("_n"), F.col("url").alias("_u"), F.lit(True).alias("_own"))
    before = modules.select(F.col("sha").alias("parent"), "path", F.col("name").alias("_pn"), F.col("url").alias("_pu"))
    row = gitlinks.join(own, ["sha", "path"], "left").join(parents, "sha", "left").join(before, ["parent", "path"], "left")
    return row.select(
        "sha", "path", F.coalesce("_n", "_pn", "path").alias("name"), F.when(F.col("_own"), F.col("_u")).otherwise(F.col("_pu")).alias("url")
    )


def align(records: DataFrame, annotations: DataFrame, key: str = "sha") -> DataFrame:
    """Records with their annotations by key; a key on one side only is an error, never a shift."""
    both = records.withColumn("_r", F.lit(True)).join(annotations.withColumn("_a", F.lit(True)), key, "full_outer")
    fits = F.col("_r").isNotNull() & F.col("_a").isNotNull()
    checked = F.assert_true(fits, F.concat(F.lit("records and annotations disagree at "), F.col(key).cast("string")))
    return both.filter(checked.isNull()).drop("_r", "_a")


def ancestors_of(start: DataFrame, parents: DataFrame, max_rounds: int = 64, first_only: bool = False) -> DataFrame:
    """(start, sha) reachable from each start over ``parents(sha, parent, ord)``, itself included.

    Paths double in length every round, so a history of n commits needs log2(n) rounds; each round is
    checkpointed and the loop ends when nothing new is found. Raises if ``max_rounds`` do not suffice.
    """
    edges = parents.filter("ord = 0") if first_only else parents
    jump = checkpointed(edges.select("sha", "parent").distinct())
    reach = checkpointed(start.select(F.col("sha").alias("start"), "sha").distinct())
    size = reach.count()
    for _ in range(max_rounds):
        step = reach.join(jump, "sha").select("start", F.col("parent").alias("sha"))
        reach = checkpointed(reach.union(step).distinct())
        now = reach.count()
        if now == size:
            return reach
        size = now
        further = jump.alias("a").join(jump.alias("b"), F.col("a.parent") == F.col("b.sha")).select("a.sha", "b.parent")
        jump = checkpointed(jump.union(further).distinct())
    raise RuntimeError(f"the ancestry is not complete after {max_rounds} rounds")
