"""What is known of a change when it is made: size, spread, content, areas, kind of change."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, directory

# Fixed values.
FILE_CLASSES = ("code", "test", "doc", "config", "build", "yang", "patch", "binary", "submodule", "other")
PRECEDENCE = (
    "revert", "submodule-bump", "docs", "test", "dependency-bump", "platform-support", "fix", "build-ci", "feature",
    "chore",
)
# Patterns and tags of the change types.
FIX_SUBJECT = (
    r"(?i)\b(fix(e[sd]|ing)?|bug(s|fix|fixes)?|hotfix|crash(es|ed)?|leak(s|ed)?|regression|broken|incorrect|wrong|"
    r"hang(s|ing)?|race|deadlock|segfault|panic|core ?dump|workaround|cve-\d+|vulnerabilit(y|ies)|typo)\b"
)
FIX_BODY = r"(?im)^\s*(fix(es|ed)?|close[sd]?|resolve[sd]?)\s*:?\s*(#\d+|https://github\.com/\S+/issues/\d+)"
DEPENDENCY_SUBJECT = r"(?i)\b(bump|upgrade|update|uprev)s?\b.*?(\bv?\d+(\.\d+)+\b|\bversions?\b|\bfrom\b.*\bto\b)"
PLATFORM_SUBJECT = (
    r"(?i)\b(add|adding|added|support|introduce|new|onboard)\b.*?"
    r"\b(platform|hwsku|sku|board|asic|chassis|linecard)s?\b"
)
FEATURE_SUBJECT = (
    r"(?i)^(\[[^\]]*\]\s*|[\w./-]+:\s*)*(add|adding|added|support|introduce|implement|enable|new)\b|\bfeature\b"
)
TEST_TAGS = ("test", "tests", "unit test", "unittest", "pytest", "ut")
BUILD_CI_TAGS = ("ci", "build", "azp", "pipeline", "pipelines", "github", "actions", "makefile")
DEPENDENCY_PATHS = r"(^|/)(files/build/versions/|requirements[^/]*\.txt$|go\.(mod|sum)$)"
CI_PATHS = r"^(\.github/|\.azure-pipelines/|azure-pipelines[^/]*\.yml$|jenkins/|Jenkinsfile$)"


def commit_features(files: DataFrame) -> DataFrame:
    """Size, spread and mix of each commit's files.

    ``files(sha, path, status, binary, additions, deletions, file_class)``. Entropy is
    log2(T) - sum(w log2 w) / T, which needs one aggregation and no second pass for T.
    """
    text = ~F.col("binary")
    added = F.when(text, F.coalesce("additions", F.lit(0))).otherwise(0)
    removed = F.when(text, F.coalesce("deletions", F.lit(0))).otherwise(0)
    weight = added + removed
    top = directory(F.col("path"))
    depth = F.size(F.split("path", "/"))
    total = F.count(F.lit(1))
    of = lambda *names: F.count_if(F.col("file_class").isin(*names))
    sums = files.groupBy("sha").agg(
        total.alias("file_count"), F.sum(added).cast("bigint").alias("additions"),
        F.sum(removed).cast("bigint").alias("deletions"),
        F.count_distinct(F.when(top == "", "<root>").otherwise(top)).alias("directory_count"),
        F.count_distinct(F.when(depth > 1, F.substring_index("path", "/", 1)).otherwise("<root>")).alias("subsystem_count"),
        F.sum(F.when(weight > 0, weight * F.log2(weight)).otherwise(0.0)).alias("_wlogw"),
        F.max(depth).cast("bigint").alias("max_path_depth"),
        *[F.count_if(F.col("status").isin(*codes)).alias(f"{name}_file_count") for name, codes in (
            ("added", "A"), ("deleted", "D"), ("modified", "MT"), ("renamed", "RC")) for codes in [tuple(codes)]],
        (of("doc") == total).alias("is_doc_only"), (of("test") == total).alias("is_test_only"),
        (of("submodule") == total).alias("is_submodule_only"), (of("test") > 0).alias("touches_tests"),
        *[of(name).alias(f"{name}_file_count") for name in FILE_CLASSES],
    )
    churn = F.col("additions") + F.col("deletions")
    entropy = F.when(churn > 0, F.abs(F.round(F.log2(churn) - F.col("_wlogw") / churn, 6))).otherwise(0.0)
    return sums.withColumn("churn", churn).withColumn("entropy", entropy).withColumn(
        "entropy_normalized",
        F.when(F.col("file_count") > 1, F.round(F.col("entropy") / F.log2("file_count"), 6)).otherwise(0.0),
    ).drop("_wlogw")


def change_types(messages: DataFrame, files: DataFrame) -> DataFrame:
    """Ordered types of each commit with the reasons of every match.

    ``messages(sha, subject, tags, body, is_revert)``, ``files(sha, status, path, new_path, file_class)``.
    Type tests over files are counts per commit, so a commit with many files stays one small row.
    """
    moved = (F.col("file_class") == "submodule") & (F.col("status") == "M")
    plain = F.col("file_class").isin("build", "config", "doc", "other")
    per = files.groupBy("sha").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(moved).alias("moved"),
        F.bool_and((F.col("file_class") == "submodule") | plain).alias("others_plain"),
        F.count_if(F.col("file_class") == "doc").alias("docs"), F.count_if(F.col("file_class") == "test").alias("tests"),
        F.count_if(F.col("path").rlike(DEPENDENCY_PATHS)).alias("pins"),
        F.count_if((F.col("status") == "A") & F.coalesce("new_path", F.lit("")).startswith("device/")).alias("devices"),
        F.count_if(F.col("path").startswith("device/") | F.col("path").startswith("platform/")).alias("hardware"),
        F.count_if(F.col("path").rlike(CI_PATHS) | (F.col("file_class") == "build")).alias("builds"),
    )
    nth = F.row_number().over(Window.partitionBy("sha").orderBy("new_path"))
    three = files.filter(moved).withColumn("_n", nth).filter("_n <= 3").groupBy("sha").agg(
        F.array_join(F.array_sort(F.collect_list("new_path")), ", ").alias("moved_names")
    )
    row = messages.join(per, "sha", "left").join(three, "sha", "left").na.fill(
        0, ["n", "moved", "docs", "tests", "pins", "devices", "hardware", "builds"]
    )
    subject, total = F.col("subject"), F.col("n")

    def first_tag(tags: Sequence[str]) -> Column:
        return F.get(F.array_sort(F.array_intersect("tags", F.array(*[F.lit(tag) for tag in tags]))), 0)

    def quoted(text: Column) -> Column:
        """Text in quotes; double ones where it holds single ones only."""
        escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(F.instr(text, "'").eqNullSafe(0) | (F.instr(text, '"') > 0), single).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))

    def cut(pattern: str) -> Column:
        return quoted(F.left(F.regexp_extract(subject, pattern, 0), F.lit(40)))

    some = total > 0
    # The wording of the reasons.
    reasons: dict[str, Column] = {
        "revert": F.when(F.col("is_revert"), "subject is a revert"),
        "submodule-bump": F.when(
            (F.col("moved") > 0) & F.col("others_plain"), F.concat(F.lit("gitlinks moved: "), "moved_names")
        ),
        "docs": F.when(some & (F.col("docs") == total), F.concat(F.lit("all "), total, F.lit(" files are documentation"))),
        "test": F.when(some & (F.col("tests") == total), F.concat(F.lit("all "), total, F.lit(" files are tests"))).when(
            first_tag(TEST_TAGS).isNotNull(), F.concat(F.lit("subject tag "), quoted(first_tag(TEST_TAGS)))
        ),
        "dependency-bump": F.when(F.lower(subject).contains("dependabot"), "automated dependency update").when(
            subject.rlike(DEPENDENCY_SUBJECT) & (F.col("moved") == 0), F.concat(F.lit("subject: "), cut(DEPENDENCY_SUBJECT))
        ).when(some & (F.col("pins") == total), "only version pins changed"),
        "platform-support": F.when(
            (F.col("devices") > 0) & (F.col("hardware") * 2 >= total),
            F.concat("devices", F.lit(" files added under device/")),
        ).when(subject.rlike(PLATFORM_SUBJECT), F.concat(F.lit("subject: "), cut(PLATFORM_SUBJECT))),
        "fix": F.when(
            subject.rlike(FIX_SUBJECT), F.concat(F.lit("subject keyword "), quoted(F.lower(F.regexp_extract(subject, FIX_SUBJECT, 0))))
        ).when(F.col("body").rlike(FIX_BODY), "body references a fixed issue"),
        "build-ci": F.when(some & (F.col("builds") == total), "only build or CI files changed").when(
            first_tag(BUILD_CI_TAGS).isNotNull(), F.concat(F.lit("subject tag "), quoted(first_tag(BUILD_CI_TAGS)))
        ),
        "feature": F.when(
            subject.rlike(FEATURE_SUBJECT),
            F.concat(F.lit("subject: "), quoted(F.left(F.trim(F.regexp_extract(subject, FEATURE_SUBJECT, 0)), F.lit(40)))),
        ),
    }
    hits = F.filter(
        F.array(*[F.struct(F.lit(kind).alias("type"), why.alias("reason")) for kind, why in reasons.items()]),
        lambda hit: hit["reason"].isNotNull(),
    )
    chore = F.array(F.struct(F.lit("chore").alias("type"), F.lit("no rule matched").alias("reason")))
    found = row.withColumn("hits", F.when(F.size(hits) > 0, hits).otherwise(chore))
    return found.select(
        "sha", F.element_at("hits", 1)["type"].alias("change_type"),
        F.transform("hits", lambda hit: hit["type"]).alias("change_types"),
        F.transform("hits", lambda hit: F.concat(hit["type"], F.lit(": "), hit["reason"])).alias("evidence"),
    ).withColumn(
        "fix_like", F.array_contains("change_types", "fix") & (F.col("change_type") != "revert")
    )


def components(paths: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(sha, component, path_count): every rule whose regex the whole path matches counts.

    ``rules`` are (id, regex) pairs; each distinct path is tested once.
    """
    tests = F.array_compact(F.array(*[F.when(F.col("path").rlike(f"^(?:{regex})$"), rule) for rule, regex in rules]))
    known = paths.select("path").distinct().select("path", F.explode(tests).alias("component"))
    return paths.select("sha", "path").distinct().join(known, "path").groupBy("sha", "component").agg(
        F.count(F.lit(1)).alias("path_count")
    )


def unmapped_paths(paths: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Distinct paths of each commit that no rule matches."""
    none = ~F.lit(False)
    for _rule, regex in rules:
        none = none & ~F.col("path").rlike(f"^(?:{regex})$")
    return paths.select("sha", "path").distinct().filter(none)


def feature_areas(paths: DataFrame, areas: DataFrame) -> DataFrame:
    """(sha, area, path_count) of areas whose prefix equals or contains the path. ``areas(area, prefix)``."""
    climbed = paths.select("sha", "path").distinct().select("sha", "path", F.explode(ancestors(F.col("path"))).alias("prefix"))
    return climbed.join(areas, "prefix").groupBy("sha", "area").agg(F.count_distinct("path").alias("path_count"))


DOCKER_RULE = r"^docker-(.+)\.(?:mk|dep)$"


def path_entities(
    paths: DataFrame, gitlinks: DataFrame | None = None, vendor_exclude: Sequence[str] = (),
    hwsku_exclude: Sequence[str] = (), asic_exclude: Sequence[str] = (),
) -> DataFrame:
    """(sha, kind, name, path_count): vendors, platforms, units, chips and images named by path segments."""
    part = F.split("path", "/")
    at = lambda n: F.coalesce(F.get(part, n), F.lit(""))
    size = F.size(part)
    device = (at(0) == "device") & (size >= 3) & ~at(1).isin(*vendor_exclude or [""])
    chip = (at(0) == "platform") & (size >= 3) & ~at(1).isin(*asic_exclude or [""])
    rule = lambda name: F.regexp_extract(name, DOCKER_RULE, 1)
    after = lambda name: F.substr(name, F.lit(len("docker-") + 1))
    image = (
        F.when(chip & (size >= 4) & at(2).startswith("docker-"), after(at(2)))
        .when(chip & (size == 3), rule(at(2)))
        .when((at(0) == "dockers") & (size >= 3) & at(1).startswith("docker-"), after(at(1)))
        .when((at(0) == "rules") & (size == 2), rule(at(1)))
    )
    named = {
        "vendor": F.when(device, at(1)), "platform": F.when(device & (size >= 4), at(2)),
        "hwsku": F.when(device & (size >= 5) & ~at(3).isin(*hwsku_exclude or [""]), at(3)),
        "asic": F.when(chip, at(1)), "docker": image,
    }
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), name.alias("name")) for kind, name in named.items()])
    found = paths.select("sha", "path").distinct().select("sha", "path", F.explode(kinds).alias("e")).select(
        "sha", "path", "e.kind", "e.name"
    )
    if gitlinks is not None:
        found = found.unionByName(gitlinks.select("sha", "path", F.lit("submodule").alias("kind"), "name"))
    return found.filter("name <> ''").groupBy("sha", "kind", "name").agg(F.count_distinct("path").alias("path_count"))


def one_hot(memberships: DataFrame, value: str, names: Sequence[str], prefix: str) -> DataFrame:
    """0/1 columns over a fixed list of names, in that order."""
    wide = memberships.groupBy("sha").pivot(value, list(names)).agg(F.lit(1))
    return wide.select("sha", *[F.coalesce(F.col(f"`{name}`"), F.lit(0)).alias(f"{prefix}__{name}") for name in names])
