"""Which entities a change reaches, and which of them CI builds, never builds, or cannot decide.

All tables may carry many trees at once: ``scope`` columns (a revision, say) join along.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import class_weight, fanout_weight, share
from ..functions.paths import ancestors, arch_of, basename, directory, join_relative
from ..session import checkpointed

# Fixed values.
WEIGHT_PATH_CLASS = 0.30
WEIGHT_ENTITY_FANOUT = 0.20
WEIGHT_COVERAGE_GAP = 0.30
WEIGHT_AMBIGUITY = 0.20
LINK_MODE = "120000"


def identify(paths: DataFrame, markers: DataFrame) -> DataFrame:
    """Adapters of which a whole marker group exists among the paths or their directories.

    ``markers(adapter, grp, marker)``: relational division; more than one answer means the tree is
    ambiguous.
    """
    # Only directories that are asked for are told apart.
    known = paths.select(F.explode(ancestors(F.col("path"))).alias("marker")).join(markers.select("marker").distinct(), "marker", "left_semi").distinct()
    need = markers.groupBy("adapter", "grp").agg(F.count_distinct("marker").alias("_need"))
    have = markers.distinct().join(known, "marker", "left_semi").groupBy("adapter", "grp").agg(F.count(F.lit(1)).alias("_have"))
    return have.join(need, ["adapter", "grp"]).filter("_have = _need").select("adapter").distinct()


def families_in(body: Column) -> Column:
    """Non-blank lines of a declaration as a sorted set."""
    names = F.transform(F.split(body, "\n"), lambda line: F.regexp_replace(line, r"^\s+|\s+$", ""))
    return F.array_sort(F.array_distinct(F.filter(names, lambda name: name != "")))


def entity_index(
    tree: DataFrame, root: str, declaration: str, shared_suffix: str, unit_markers: Sequence[str] = (),
    identity_marker: str = "", arch_prefixes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Directories ``root/vendor/name`` that hold the declaration file, with their marks.

    Shared directories (by suffix) are kept but flagged, so that what was excluded can be counted;
    unit and identity markers are recorded and never exclude anything. ``tree(path, mode)``.
    """
    part = F.split("path", "/")
    inside = tree.filter(F.col("path").startswith(root + "/") & (F.size(part) >= 4))
    own = F.size(part) == 4
    last = basename(F.col("path"))
    marked = inside.withColumn("directory", F.array_join(F.slice(part, 1, 3), "/"))
    dirs = marked.groupBy("directory").agg(
        F.bool_or(own & (last == declaration)).alias("declared"),
        F.bool_or(own & (last == declaration) & (F.col("mode") == LINK_MODE)).alias("is_link"),
        F.bool_or((F.size(part) >= 5) & last.isin(*unit_markers or [""])).alias("owns_unit"),
        F.bool_or(own & (last == identity_marker)).alias("declares_identity"),
    ).filter("declared")
    name = F.split_part("directory", F.lit("/"), F.lit(3))
    return dirs.select(
        F.concat_ws("/", F.split_part("directory", F.lit("/"), F.lit(2)), name).alias("id"),
        F.split_part("directory", F.lit("/"), F.lit(2)).alias("vendor"), name.alias("name"), "directory", "is_link",
        "owns_unit", "declares_identity", name.endswith(shared_suffix).alias("shared"),
        (arch_of(name, arch_prefixes) if arch_prefixes else F.lit("")).alias("arch"),
    )


def file_entities(tree: DataFrame, pattern: str) -> DataFrame:
    """Entities that are files: the first capture of ``pattern`` names them."""
    return tree.filter(F.col("path").rlike(pattern)).select(
        F.regexp_extract("path", pattern, 1).alias("id"), "path", directory(F.col("path")).alias("directory")
    )


def resolve_links(links: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The path each link finally lands on, which may be a directory or gone; null for loops.

    ``links(scope.., path, target)`` hold link texts. Each round doubles the hops taken; a chain has no more hops
    than there are links, so what still is a link after log2 of their number of rounds loops. A target above
    the root is an error.
    """
    where = join_relative(F.col("path"), F.col("target"))
    above = where.startswith("../") | (where == "..") | F.col("target").startswith("/")
    steps = checkpointed(links.select(
        *scope, "path", F.when(above, F.raise_error(F.concat(F.lit("link leaves the tree: "), "path"))).otherwise(where).alias("to")
    ))
    keys = [*scope, "at"]
    still = steps.select(*scope, F.col("path").alias("at")).withColumn("_link", F.lit(True))
    going, hops, links_in_all = steps.select(*scope, "path", F.col("to").alias("at")), 1, steps.count()
    while hops < links_in_all and not going.join(still, keys, "left_semi").isEmpty():
        further = going.select(*scope, F.col("path").alias("at"), F.col("at").alias("next"))
        going = checkpointed(going.join(further, keys, "left").select(*scope, "path", F.coalesce("next", "at").alias("at")))
        hops *= 2
    return going.join(still, keys, "left").select(*scope, "path", F.when(F.col("_link").isNull(), F.col("at")).alias("resolved"))


def alias_entities(links: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity directories that are links: a second entity with the target's data and its own name.

    ``links(path, resolved)`` of directories, ``entities(id, directory, families, arch, ..)``.
    """
    source = entities.drop("id", "vendor", "name").withColumnRenamed("directory", "resolved")
    return links.filter("resolved is not null").join(source, "resolved").select(
        F.concat_ws("/", F.split_part("path", F.lit("/"), F.lit(2)), F.split_part("path", F.lit("/"), F.lit(3))).alias("id"),
        F.split_part("path", F.lit("/"), F.lit(2)).alias("vendor"), F.split_part("path", F.lit("/"), F.lit(3)).alias("name"),
        F.col("path").alias("directory"), *[name for name in source.columns if name != "resolved"],
    )


def climb(paths: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(keep.., path, up): every distinct path with itself and its directories."""
    return paths.select(*keep, "path").distinct().select(*keep, "path", F.explode(ancestors(F.col("path"))).alias("up"))


def under(paths: DataFrame, roots: DataFrame, keep: Sequence[str], scope: Sequence[str]) -> DataFrame:
    """(scope.., keep.., path, id) of the paths that are ``up`` of ``roots(scope.., up, id)`` or lie below it.

    Each different path climbs once, however many changes name it, and only to depths at which there are roots: a directory above
    all roots would meet none, but bring every path to one task.
    """
    depths = roots.agg(F.collect_set(F.size(F.split("up", "/")))).scalar()
    ups = climb(paths, scope).filter(F.array_contains(depths, F.size(F.split("up", "/"))))
    per_path = ups.join(roots, [*scope, "up"]).select(*scope, "path", "id")
    if not keep:
        return per_path
    return paths.select(*scope, *keep, "path").distinct().join(per_path.distinct(), [*scope, "path"]).select(*scope, *keep, "path", "id")


def owning(paths: DataFrame, entities: DataFrame, keep: Sequence[str] = (), scope: Sequence[str] = ()) -> DataFrame:
    """(keep.., path, id) of entities whose directory is the path or contains it: an equi-join.

    ``keep`` columns come along from the paths; ``scope`` columns stand on both sides and must agree.
    """
    roots = entities.select(*scope, F.col("directory").alias("up"), "id")
    return under(paths, roots, keep, scope)


def reaching(
    paths: DataFrame, links: DataFrame, entities: DataFrame, keep: Sequence[str] = (), scope: Sequence[str] = (), depth: int = 3
) -> DataFrame:
    """(keep.., path, id) of entities that own a link landing on the path or on a directory above it."""
    owners = links.filter("resolved is not null").select(
        *scope, F.col("resolved").alias("up"), F.array_join(F.slice(F.split("path", "/"), 1, depth), "/").alias("directory")
    ).distinct().join(entities.select(*scope, "directory", "id"), [*scope, "directory"])
    # A directory may hold many links to one place, so owners are made distinct before the join.
    targets = owners.select(*scope, "up", "id").distinct()
    found = under(paths, targets, keep, scope)
    return found if keep else found.distinct()


def linking_into(
    paths: DataFrame, shared: DataFrame, declarations: DataFrame, keep: Sequence[str] = (), scope: Sequence[str] = ()
) -> DataFrame:
    """(keep.., path, id) of entities whose declaration resolves into the shared directory that holds the path."""
    within = declarations.select(*scope, "id", F.explode(ancestors(F.col("resolved"), proper=True)).alias("directory")).join(
        shared.select(*scope, "directory"), [*scope, "directory"]
    )
    found = under(paths, within.withColumnRenamed("directory", "up").distinct(), keep, scope)
    return found if keep else found.distinct()


def affected(*reached: DataFrame) -> DataFrame:
    """One row per path and entity, however many ways it is reached."""
    everything = reached[0]
    for other in reached[1:]:
        everything = everything.unionByName(other)
    return everything.distinct()


def reached_sets(changed: DataFrame, wide: DataFrame, narrow: DataFrame, scope: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``changed(scope.., path)`` reaches, each entity once per scope, without a row for every one that a set brings.

    ``wide(path, id)`` are paths that reach many entities each, ``narrow(path, id)`` the others. Returns ``sets(scope.., path)``, ``members(path, id)``
    and ``rows(scope.., id)``: a scope reaches the members of its sets and its rows, and no entity twice. An entity in several wide sets stands in no
    set but goes by rows.
    """
    touched = changed.select(*scope, "path").distinct()
    wide = wide.select("path", "id").distinct()
    several = wide.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("id")
    members = wide.join(several, "id", "left_anti").select("path", "id")
    sets = touched.join(members.select("path").distinct(), "path", "left_semi").select(*scope, "path")
    single = wide.join(several, "id", "left_semi").select("path", "id").unionByName(narrow.select("path", "id")).distinct()
    rows = touched.join(single, "path").select(*scope, "id").distinct().join(members, "id", "left")
    return sets, members, rows.join(sets, [*scope, "path"], "left_anti").select(*scope, "id")


def built_families(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(families certainly built, (family, group) of families built for one architecture only).

    ``groups(name, family, arch, qualifier)``. A group's own name always counts; its family too, unless
    name and family differ and the group names an architecture.
    """
    qualified = (F.col("family") != F.col("name")) & (F.coalesce("qualifier", F.lit("")) != "")
    built = groups.select(F.col("name").alias("family")).unionByName(groups.filter(~qualified).select("family")).distinct()
    aliases = groups.filter(qualified).select("family", F.col("name").alias("job_group")).distinct()
    return built, aliases


def coverage(wanted: DataFrame, entities: DataFrame, groups: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Status and architecture answer of every wanted entity: covered, ambiguous or uncovered.

    ``wanted(keep.., id)``, ``entities(id, families, arch)``. Entities missing from the index are
    uncovered and unknown. One status column makes the three sets disjoint and exhaustive.
    """
    built, aliases = built_families(groups)
    declared = entities.select("id", "arch", F.explode("families").alias("family"))
    hits = declared.join(built, "family", "left_semi").groupBy("id").agg(F.lit(True).alias("_built"))
    maybe = declared.join(aliases, "family").groupBy("id").agg(F.lit(True).alias("_maybe"))
    decided = declared.filter("arch <> ''").join(
        groups.select(F.col("family"), F.col("arch"), F.col("name").alias("job_group")).distinct(), ["family", "arch"]
    ).groupBy("id").agg(F.array_sort(F.collect_set("job_group")).alias("job_groups"))
    known = entities.select("id", "arch", "families")
    # The answer depends on the entity alone, so it is found once for each and joined once.
    row = known.join(hits, "id", "left").join(maybe, "id", "left").join(decided, "id", "left")
    status = F.when(F.col("_built"), "covered").when(F.col("_maybe"), "ambiguous").otherwise("uncovered")
    resolution = F.when(
        status == "ambiguous",
        F.when(F.size("job_groups") > 0, "covered").when(F.coalesce("arch", F.lit("")) != "", "uncovered").otherwise("undetermined"),
    )
    answers = row.select(
        "id", status.alias("_status"), resolution.alias("resolution"),
        F.when(status == "ambiguous", F.coalesce("job_groups", F.array().cast("array<string>"))).alias("job_groups"),
        ((status == "uncovered") & (F.size("families") == 0)).alias("_unknown"), "arch", "families",
    )
    return wanted.select(*keep, "id").distinct().join(answers, "id", "left").select(
        *keep, "id", F.coalesce("_status", F.lit("uncovered")).alias("status"), "resolution", "job_groups",
        F.coalesce("_unknown", F.lit(True)).alias("unknown"), "arch", "families",
    )


def coverage_counts(result: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Sizes of the three sets and the never-built totals of both readings."""
    is_ = lambda name: F.count_if(F.col("status") == name)
    return result.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("affected"), is_("covered").alias("covered"), is_("uncovered").alias("uncovered"),
        is_("ambiguous").alias("ambiguous"),
        (is_("uncovered") + is_("ambiguous")).alias("string_equality"),
        (is_("uncovered") + F.count_if(F.coalesce(F.col("resolution") == "uncovered", F.lit(False)))).alias("architecture_aware"),
        F.count_if(F.coalesce(F.col("resolution") == "undetermined", F.lit(False))).alias("undetermined"),
        F.count_if("unknown").alias("unknown"),
    )


def set_counts(sets: DataFrame, members: DataFrame, rows: DataFrame, answers: DataFrame, scope: Sequence[str]) -> DataFrame:
    """``coverage_counts`` of ``reached_sets``: the members of a set are counted once, not for each scope that touches it."""
    each = coverage_counts(members.join(answers, "id"), ["path"])
    names = [name for name in each.columns if name != "path"]
    parts = sets.join(each, "path").select(*scope, *names).unionByName(coverage_counts(rows.join(answers, "id"), scope).select(*scope, *names))
    return parts.groupBy(*scope).agg(*[F.sum(name).alias(name) for name in names])


def rule_candidates(result: DataFrame) -> DataFrame:
    """The rule's answer per ambiguous entity."""
    return result.filter("status = 'ambiguous'").select(
        "id", F.when(F.coalesce("arch", F.lit("")) == "", "unknown").otherwise(F.col("arch")).alias("arch"), "families",
        "resolution", "job_groups",
    )


def family_members(entities: DataFrame) -> DataFrame:
    """Family to the number of entities declaring it. The pairs themselves stay rows: ``explode`` of families."""
    return entities.select("id", F.explode("families").alias("family")).groupBy("family").agg(
        F.count_distinct("id").alias("members"), F.min("id").alias("first")
    )


def hotspots(
    files: DataFrame, reached: DataFrame, result: DataFrame, class_count: int, scope: Sequence[str] = (), limit: int = 10
) -> DataFrame:
    """The ``limit`` highest-scored paths with the four components of each score.

    ``files(scope.., path, rank)``, ``reached(scope.., path, id)``, ``result(scope.., id, status)``. Where what a path reaches is the same in
    every scope, ``reached`` and ``result`` come without the scope and have a row per path, not one per change of it.
    """
    by = [name for name in scope if name in reached.columns]
    fan = reached.join(result.select(*by, "id", "status"), [*by, "id"]).groupBy(*by, "path").agg(
        F.count(F.lit(1)).alias("fanout"), F.count_if(F.col("status") == "uncovered").alias("_u"),
        F.count_if(F.col("status") == "ambiguous").alias("_a"),
    )
    row = files.join(fan, [*by, "path"], "left").na.fill(0, ["fanout", "_u", "_a"])
    part = {
        "path_class": WEIGHT_PATH_CLASS * class_weight(F.col("rank"), class_count),
        "entity_fanout": WEIGHT_ENTITY_FANOUT * fanout_weight(F.col("fanout")),
        "coverage_gap": WEIGHT_COVERAGE_GAP * share(F.col("_u"), F.col("fanout")),
        "ambiguity": WEIGHT_AMBIGUITY * share(F.col("_a"), F.col("fanout")),
    }
    scored = row.select(*scope, "path", "fanout", *[F.round(value, 3).alias(name) for name, value in part.items()])
    total = sum((F.col(name) for name in part), F.lit(0.0))
    ranked = scored.withColumn("score", F.round(total, 3))
    order = [F.desc("score"), F.asc("path")]
    if not scope:
        # A global top list is a bounded sort; its few rows are then numbered.
        top = ranked.orderBy(*order).limit(limit)
        return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return ranked.withColumn("position", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).filter(
        F.col("position") <= limit
    )


def related_groups(changed: DataFrame, groups: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """(selected groups with rule and matched paths, (repo, prefix) still to look at).

    ``changed(path)``, ``groups(grp, repo, prefix)``. The groups all matched paths share, or every hit
    group if they share none. Listed prefixes leave out those that hold a changed path.
    """
    own = groups.filter(F.col("repo") == repo).select("grp", F.col("prefix").alias("up")).distinct()
    hits = checkpointed(climb(changed).join(own, "up").select("grp", "path").distinct())
    matched = hits.agg(F.count_distinct("path")).scalar()
    counts = hits.groupBy("grp").agg(F.count(F.lit(1)).alias("n_changed")).withColumn("_all", matched)
    shared = counts.agg(F.bool_or(F.col("n_changed") == F.col("_all"))).scalar()
    selected = counts.withColumn("_any", shared).filter(~F.col("_any") | (F.col("n_changed") == F.col("_all"))).select(
        "grp", F.when(F.col("_any"), "shared").otherwise("union").alias("rule"), "n_changed"
    )
    touched = climb(changed).select(F.lit(repo).alias("repo"), F.col("up").alias("prefix")).distinct()
    assess = groups.join(selected.select("grp"), "grp").select("repo", "prefix").distinct().join(
        touched, ["repo", "prefix"], "left_anti"
    )
    return selected, assess


def partition_problems(result: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entities in no set, in two sets, or not asked for; empty when the sets partition the wanted ones."""
    placed = result.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    both = placed.join(wanted.select("id").distinct().withColumn("_w", F.lit(True)), "id", "full_outer")
    problem = F.when(F.col("_w").isNull(), "not asked for").when(F.col("n").isNull(), "in no set").when(F.col("n") > 1, "in two sets")
    return both.select("id", problem.alias("problem")).filter("problem is not null")


def closed_world(result: DataFrame, entities: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, kind, members) of everything a report on these results may name."""
    members = entities.join(result.select("id"), "id", "left_semi")
    families = members.select(F.explode("families").alias("family")).distinct()
    sizes = entities.select("id", F.explode("families").alias("family")).groupBy("family").agg(F.count_distinct("id").alias("members"))
    vendors = entities.groupBy("vendor").agg(F.count(F.lit(1)).alias("members"))
    own = members.select(F.concat(F.lit("platform:"), "id").alias("id"), F.lit("platform").alias("kind"), F.lit(1).cast("bigint").alias("members"))
    fam = families.join(sizes, "family").select(F.concat(F.lit("asic_family:"), "family"), F.lit("asic_family"), "members")
    ven = members.select("vendor").distinct().join(vendors, "vendor").filter("vendor <> ''").select(F.concat(F.lit("vendor:"), "vendor"), F.lit("vendor"), "members")
    job = groups.select(F.col("name").alias("family")).distinct().join(sizes, "family", "left").select(
        F.concat(F.lit("ci_job_group:"), "family"), F.lit("ci_job_group"), F.coalesce("members", F.lit(0)))
    return own.union(fam).union(ven).union(job)


def brief_problems(
    spots: DataFrame, counts: DataFrame, result: DataFrame, named: DataFrame, world: DataFrame
) -> DataFrame:
    """(rule, subject) of every broken contract of a brief; empty when it holds.

    Components add up to scores; the sets add up to the affected count; the counting equation
    holds; every named entity is in the closed world; candidates imply the architecture-aware total.
    """
    parts = F.round(F.col("path_class") + F.col("entity_fanout") + F.col("coverage_gap") + F.col("ambiguity"), 6)
    sums = spots.filter(F.abs(parts - F.col("score")) > 1e-9).select(F.lit("score").alias("rule"), F.col("path").alias("subject"))
    sets = counts.filter("covered + uncovered + ambiguous <> affected").select(F.lit("partition"), F.lit("coverage"))
    outside = named.join(world.select("id"), "id", "left_anti").select(F.lit("closed_world"), "id")
    implied = result.agg(
        F.count_if((F.col("status") == "uncovered") | F.coalesce(F.col("resolution") == "uncovered", F.lit(False)))
    ).scalar()
    totals = counts.withColumn("_i", implied).filter("architecture_aware <> _i").select(F.lit("candidate_total"), F.lit("coverage"))
    return sums.union(sets).union(outside).union(totals)


def signature_groups(rows: DataFrame, key: Sequence[str], member: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(group per equal signature with size and first member, members of groups beyond ``limit``, none without one; a report usually shows 8).

    Signatures hash their columns, so long arrays do not travel; groups are numbered by first member.
    """
    marked = rows.withColumn("signature", F.sha2(F.to_json(F.struct(*key)), 256))
    groups = marked.groupBy("signature").agg(F.count(F.lit(1)).alias("members"), F.min(member).alias("representative"))
    top = groups if limit is None else groups.orderBy("representative").limit(limit)
    rest = marked.join(top.select("signature"), "signature", "left_anti").select(member)
    return top.select("representative", "members"), rest


def shared_units(names: DataFrame, holders: DataFrame) -> DataFrame:
    """(name, entity): the entity first by directory that has a unit of that name.

    ``names(cls, name)`` are the units of a class and ``holders(cls, id, directory)`` the entities that have all units of the class; the first
    holder is found per class, so units and entities never meet in pairs.
    """
    first = holders.groupBy("cls").agg(F.min_by(F.struct("id", "directory"), "directory").alias("_first"))
    return names.distinct().join(first, "cls").groupBy("name").agg(F.min_by("_first.id", "_first.directory").alias("entity"))


def vocabulary(entities: DataFrame, groups: DataFrame, tree: DataFrame | None, markers: Sequence[str], root: str, units: DataFrame | None = None) -> DataFrame:
    """(kind, entity, name): every name a text may use for a platform, family, vendor or hardware unit.

    Units are the ``markers`` below the entities in ``tree``, or, without it, ``units(name, entity)``.
    """
    families = entities.select(F.explode("families").alias("f")).union(groups.select("family")).union(groups.select("name")).distinct()
    part = F.split("path", "/")
    units = units if tree is None else tree.filter((F.size(part) == 5) & (part[0] == root) & part[4].isin(*markers)).select(
        F.concat_ws("/", part[1], part[2]).alias("id"), part[3].alias("name"), "path"
    ).join(entities.select("id"), "id", "left_semi").groupBy("name").agg(F.min_by("id", "path").alias("entity"))
    return (
        entities.select(F.lit("vendor").alias("kind"), F.col("vendor").alias("entity"), F.col("vendor").alias("name")).distinct()
        .union(families.select(F.lit("family"), "f", "f"))
        .union(entities.select(F.lit("platform"), "id", "name"))
        .union(units.select(F.lit("platform"), "entity", "name")).distinct()
    )
