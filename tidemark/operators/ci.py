"""CI results per change: attempts, labels, base rates, path priors, reach and the rule score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import PathRules, extension

# Sources whose path lists cannot be trusted.
UNUSABLE_SOURCES = ("unresolved", "fetch_failed", "diff_failed")


@dataclass(frozen=True)
class Reach:
    """Which jobs a path reaches, as data."""

    gold: tuple[str, ...]
    pretest: tuple[str, ...] = ()
    all_gold_buckets: tuple[str, ...] = ()
    vendors: tuple[tuple[str, Mapping[str, Sequence[str]]], ...] = ()
    bucket_jobs: Mapping[str, Sequence[str]] = field(default_factory=dict)
    tests_prefix: str = ""
    feature_segment: int = 1
    feature_jobs: Mapping[str, Sequence[str]] = field(default_factory=dict)
    unknown_feature: str = "pretest_plus_gold"

    def expand(self, spec: Sequence[str]) -> list[str]:
        """``pretest`` and ``gold`` stand for their lists; the first mention of a job keeps its place."""
        groups = {"pretest": self.pretest, "gold": self.gold}
        return list(dict.fromkeys(job for item in spec for job in groups.get(item, (item,))))

    def jobs(self, path: Column, bucket: Column) -> Column:
        """Array of jobs: all-gold buckets, then vendor, then bucket table, then tests, then pretest."""
        tiers = [F.when(bucket.isin(*self.all_gold_buckets), _strings(self.gold))] if self.all_gold_buckets else []
        part = F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(2))).otherwise("")
        for prefix, table in self.vendors:
            found = None
            for vendor, jobs in table.items():
                found = (F if found is None else found).when(part == vendor, _strings(self.expand(jobs)))
            for job in self.gold:
                named = F.replace(part, F.lit("-"), F.lit("_")) == job
                found = (F if found is None else found).when(named, _strings(self.expand(["pretest", job])))
            tiers.append(F.when(path.startswith(prefix), found))
        for name, jobs in self.bucket_jobs.items():
            tiers.append(F.when(bucket == name, _strings(self.expand(jobs))))
        if self.tests_prefix:
            feature = F.coalesce(F.get(F.split(path, "/"), self.feature_segment), F.lit(""))
            default = {"pretest_plus_gold": ["pretest", "gold"], "pretest": ["pretest"]}.get(self.unknown_feature, ["gold"])
            found = F.lit(None)
            for name, jobs in self.feature_jobs.items():
                if jobs:
                    found = F.when(feature == name, _strings(self.expand(["pretest", *jobs]))).otherwise(found)
            tiers.append(F.when(path.startswith(self.tests_prefix), F.coalesce(found, _strings(self.expand(default)))))
        return F.coalesce(*tiers, _strings(self.pretest))


@dataclass(frozen=True)
class ScoreRules:
    """Constants of the rule score."""

    cap: float = 0.35
    skip_mark: str = ""
    skip_cap: float = 1.3
    boost_buckets: tuple[str, ...] = ()
    boost_jobs: tuple[str, ...] = ()
    boost: float = 1.15
    bucket_priors: Mapping[str, float] = field(default_factory=dict)


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(value) for value in values]).cast("array<string>")


def slim_builds(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Seven fields of a build feed; the PR number comes from the branch."""
    schema = "id bigint, result string, sourceBranch string, sourceVersion string, finishTime string, startTime string"
    build = raw.select(F.from_json(column, schema).alias("b")).select("b.*")
    branch = F.coalesce("sourceBranch", F.lit(""))
    pr = F.regexp_extract(branch, r"/pull/([^/]*)", 1).try_cast("bigint")
    return build.withColumn("sourceBranch", branch).withColumn("pr", pr)


def timeline_jobs(raw: DataFrame, job_map: DataFrame, column: str = "raw") -> DataFrame:
    """(build, group, key, result): the last record with a result wins per build and mapped job.

    ``job_map(name, group, key)`` is a configured list, checked to be short before it is broadcast.
    """
    schema = "records array<struct<type: string, name: string, result: string>>"
    records = (
        raw.select("build", F.from_json(column, schema).alias("t"))
        .select("build", F.posexplode("t.records").alias("pos", "r"))
        .filter("r.type = 'Job' and r.result is not null")
        .select("build", "pos", F.coalesce("r.name", F.lit("")).alias("name"), F.col("r.result").alias("result"))
    )
    return records.join(job_map, "name").groupBy("build", "group", "key").agg(F.max_by("result", "pos").alias("result"))


def select_attempts(builds: DataFrame, max_prs: int, per_pr: int) -> DataFrame:
    """Up to ``per_pr`` newest builds of each of the ``max_prs`` PRs seen first in newest-first order."""
    usable = builds.filter("pr is not null")
    newest = usable.groupBy("pr").agg(F.max(F.struct("finish", "build")).alias("_last"))
    kept = newest.orderBy(F.desc("_last")).limit(max_prs).select("pr")
    # row_number with a small limit prunes inside every task before the shuffle.
    order = Window.partitionBy("pr").orderBy(F.desc("finish"), F.desc("build"))
    return usable.join(kept, "pr", "left_semi").withColumn("_n", F.row_number().over(order)).filter(
        F.col("_n") <= per_pr
    ).drop("_n")


def any_attempt(results: DataFrame, keys: Sequence[str] = ("pr", "job")) -> DataFrame:
    """failed if any attempt failed, else succeeded if any did, else the latest result that is not null."""
    latest = F.max_by("result", F.when(F.col("result").isNotNull(), F.struct("finish", "build")))
    return results.groupBy(*keys).agg(
        F.when(F.bool_or(F.col("result") == "failed"), "failed")
        .when(F.bool_or(F.col("result") == "succeeded"), "succeeded").otherwise(latest).alias("result")
    )


def attempt_counts(results: DataFrame) -> DataFrame:
    """Per (PR, job): failed attempts, the PR's attempts, its last build, and the job's result in that build."""
    per_pr = results.groupBy("pr").agg(
        F.count_distinct("build").alias("n_attempts"), F.max(F.struct("finish", "build")).alias("_last")
    ).select("pr", "n_attempts", F.col("_last.build").alias("last_build"))
    last = results.join(per_pr, "pr")
    return last.groupBy("pr", "job", "n_attempts", "last_build").agg(
        F.count_if(F.col("result") == "failed").alias("fail_attempts"),
        F.max(F.when(F.col("build") == F.col("last_build"), F.col("result"))).alias("latest"),
    )


def job_base_rates(labels: DataFrame, jobs: Sequence[str], base: Column) -> DataFrame:
    """failed / (failed + succeeded) over train rows, the overall base where a job has none."""
    counts = labels.filter("split = 'train'").groupBy("job").agg(
        F.count_if(F.col("result") == "failed").alias("failed"),
        F.count_if(F.col("result") == "succeeded").alias("succeeded"),
    )
    wanted = labels.sparkSession.createDataFrame([(job,) for job in jobs], "job string")
    ratio = F.try_divide(F.col("failed"), F.col("failed") + F.col("succeeded"))
    return wanted.join(counts, "job", "left").select("job", F.coalesce(ratio, base).alias("base"))


def path_job_failures(
    files: DataFrame, labels: DataFrame, min_n: int = 1, top: int | None = None
) -> DataFrame:
    """Train-only failure rate per path and job with its support ``n``. ``files(pr, path)``, ``labels(pr, job, result, split)``.

    A report may ask for rates of a support of at least ``min_n`` (usual: 5) and for the ``top`` highest (usual: 400).
    """
    graded = labels.filter("split = 'train' and result in ('succeeded', 'failed')")
    # Rows of one PR meet its few jobs; outcomes shrink to one count per (path, job) map-side.
    rates = files.select("pr", "path").join(graded, "pr").groupBy("path", "job").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("result") == "failed").alias("fail")
    )
    scored = rates.filter(F.col("n") >= min_n).withColumn("p_fail", F.round(F.col("fail") / F.col("n"), 4))
    return scored if top is None else scored.orderBy(F.desc("p_fail"), F.desc("n"), "path", "job").limit(top)


def path_usable(source: Column) -> Column:
    """Whether a path list from this source may feed a model."""
    named = F.coalesce(source, F.lit(""))
    return ~((named == "") | named.contains("two_dot") | named.isin(*UNUSABLE_SOURCES))


def pr_files(runs: DataFrame, squash: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per PR with its source tag, files of every PR from its preferred source).

    ``squash(pr, idx, path, ..)`` are the files of landed commits, of which the first commit of a PR
    counts; ``fetched(pr, source, path, ..)`` those read for open ones. PRs with neither are unresolved.
    """
    first = squash.groupBy("pr").agg(F.min("idx").alias("idx"))
    other = fetched.groupBy("pr").agg(F.max("source").alias("_fetched"))
    tagged = runs.select("pr").distinct().join(first, "pr", "left").join(other, "pr", "left").select(
        "pr", "idx",
        F.when(F.col("idx").isNotNull(), "squash").otherwise(F.coalesce("_fetched", F.lit("unresolved"))).alias("source"),
    )
    columns = [name for name in fetched.columns if name not in ("pr", "source")]
    landed = squash.join(tagged.filter("idx is not null").select("pr", "idx", "source"), ["pr", "idx"])
    opened = fetched.join(tagged.filter("idx is null").select("pr"), "pr")
    files = landed.select("pr", "source", *columns).unionByName(opened.select("pr", "source", *columns))
    return tagged.select("pr", "source", path_usable(F.col("source")).alias("usable")), files


def revert_rates(
    changes: DataFrame, commits: DataFrame, rules: PathRules, min_touches: int = 1
) -> DataFrame:
    """Touches, reverts, revert rate and lift of every path with at least ``min_touches`` (usual for a report: 50)."""
    base = commits.agg((F.count_if("is_revert") / F.count(F.lit(1))).alias("b")).scalar()
    rates = changes.join(commits.select("sha", "is_revert"), "sha").groupBy("path").agg(
        F.count(F.lit(1)).alias("touches"), F.count_if("is_revert").alias("reverts")
    ).filter(F.col("touches") >= min_touches)
    rate = F.col("reverts") / F.col("touches")
    return rates.withColumn("_base", base).select(
        "path", "touches", "reverts", F.round(rate, 6).alias("p_revert"), F.round(rate * 100, 3).alias("p_revert_pct"),
        F.coalesce(F.round(F.try_divide(rate, "_base"), 3), F.lit(0.0)).alias("lift_vs_base"),
        rules.name(F.col("path")).alias("bucket"),
    )


def priors_of(files: DataFrame, priors: DataFrame, rules: PathRules, bucket_priors: Mapping[str, float],
              base: Column) -> DataFrame:
    """Each file row with its bucket and prior: the path's own, else its bucket's, else the base rate."""
    bucket = rules.name(F.col("path"))
    fallback = base
    for name, value in bucket_priors.items():
        fallback = F.when(F.col("bucket") == name, F.lit(float(value))).otherwise(fallback)
    return files.withColumn("bucket", bucket).join(
        priors.select("path", F.col("p_revert").alias("_own")), "path", "left"
    ).withColumn("prior", F.coalesce("_own", fallback)).drop("_own")


def pr_features(
    files: DataFrame, shared_bucket: str, prefix_counts: Mapping[str, str], flags: Mapping[str, Column]
) -> DataFrame:
    """Numeric features of a PR's files. ``files(pr, path, additions, deletions, binary, bucket, prior)``."""
    n = F.count(F.lit(1))
    churn = F.coalesce(F.sum("additions"), F.lit(0)) + F.coalesce(F.sum("deletions"), F.lit(0))
    # Millionths are whole numbers: their mean does not depend on the order of addition, nor on how ties of doubles are rounded.
    millionths = F.sum(F.round(F.col("prior") * 1e6).cast("bigint"))
    mean = F.floor((2 * millionths + n) / (2 * n)) / 1e6
    return files.groupBy("pr").agg(
        n.alias("n_files"),
        F.coalesce(F.sum("additions"), F.lit(0)).alias("additions"),
        F.coalesce(F.sum("deletions"), F.lit(0)).alias("deletions"),
        churn.alias("churn"), F.count_if("binary").alias("binary_files"),
        F.round(F.log1p(churn), 4).alias("log1p_churn"), F.round(F.log1p(n), 4).alias("log1p_files"),
        F.count_if(F.col("bucket") == shared_bucket).alias("n_shared_paths"),
        F.round(F.count_if(F.col("bucket") == shared_bucket) / n, 4).alias("frac_shared"),
        F.round(F.max("prior"), 6).alias("max_revert_prior"), mean.alias("mean_revert_prior"),
        *[F.count_if(F.col("path").startswith(prefix)).alias(name) for name, prefix in prefix_counts.items()],
        *[F.bool_or(test).alias(name) for name, test in flags.items()],
    )


def histogram(files: DataFrame, value: Column) -> DataFrame:
    """Map of value to count per PR: a PR has few distinct buckets or extensions."""
    counts = files.groupBy("pr", value.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy("pr").agg(F.map_from_entries(F.collect_list(F.struct("_v", "_n"))).alias("histogram"))


def extension_or_none(path: Column) -> Column:
    return F.when(extension(path) == "", "(none)").otherwise(extension(path))


def only_submodule_pointers(
    files: DataFrame, prefixes: Sequence[str] = ("src/",), extra: Sequence[str] = (".gitmodules",)
) -> DataFrame:
    """Whether every file of a PR is a submodule pointer (or listed extra path) with at most one line each way."""
    path = F.col("path")
    under = F.lit(False)
    for prefix in prefixes:
        under = under | path.rlike("^" + _literal(prefix.rstrip("/")) + "/+[^/]+$")
    small = F.coalesce("additions", F.lit(0)).isin(0, 1) & F.coalesce("deletions", F.lit(0)).isin(0, 1)
    return files.groupBy("pr").agg(F.bool_and(path.isin(*extra) | (under & small)).alias("submodule_only"))


def _literal(text: str) -> str:
    return "".join("\\" + char if not char.isalnum() and char not in "/_" else char for char in text)


def rule_scores(
    prs: DataFrame, files: DataFrame, job_base: DataFrame, reach: Reach, rules: ScoreRules, base: Column
) -> DataFrame:
    """Rule score of every (PR, gold job): base rate of the job times the largest lift of a path reaching it.

    ``files(pr, path, bucket, prior)``. Paths never lower a score; a PR without files, or a base of 0, keeps
    the capped base rate.
    """
    prior = F.col("prior")
    if rules.skip_mark:
        capped = F.least(prior, F.col("_base") * F.lit(rules.skip_cap))
        prior = F.when(F.col("path").contains(rules.skip_mark), capped).otherwise(prior)
    lift = F.try_divide(prior, F.col("_base"))
    boosted = F.col("bucket").isin(*rules.boost_buckets) & F.col("job").isin(*rules.boost_jobs)
    lift = F.when(boosted, lift * rules.boost).otherwise(lift)
    reached = (
        files.select("pr", "path", "bucket", "prior", base.alias("_base"))
        .withColumn("job", F.explode(F.array_distinct(reach.jobs(F.col("path"), F.col("bucket")))))
        .filter(F.col("job").isin(*reach.gold) & (F.col("_base") > 0))
        .groupBy("pr", "job").agg(F.max(lift).alias("_lift"))
    )
    slots = prs.select("pr").distinct().withColumn("job", F.explode(_strings(reach.gold)))
    score = F.col("base") * F.greatest(F.lit(1.0), F.coalesce("_lift", F.lit(1.0)))
    return slots.join(reached, ["pr", "job"], "left").join(job_base, "job").select(
        "pr", "job", F.round(F.least(score, F.lit(rules.cap)), 6).alias("heuristic_p")
    )


def score_reasons(files: DataFrame, reach: Reach, path_class: Column) -> DataFrame:
    """One row per scored path: bucket, class, prior and the gold jobs it reaches."""
    jobs = F.filter(reach.jobs(F.col("path"), F.col("bucket")), lambda job: job.isin(*reach.gold))
    return files.select("pr", "path", "bucket", path_class.alias("path_class"), "prior", jobs.alias("jobs"))


def scored_scope(prs: DataFrame, changed: DataFrame, hotspots: DataFrame) -> DataFrame:
    """(pr, path, files_complete): the changed files of each PR of ``prs``; of one whose diff is not at hand, its stored hotspots, marked incomplete.

    A PR with neither has no rows; its scores are base rates.
    """
    known = changed.select("pr", "path").distinct().join(prs.select("pr").distinct(), "pr", "left_semi")
    bare = prs.select("pr").distinct().join(known.select("pr").distinct(), "pr", "left_anti")
    stored = hotspots.filter("path <> ''").select("pr", "path").distinct().join(bare, "pr", "left_semi")
    return known.withColumn("files_complete", F.lit(True)).unionByName(stored.withColumn("files_complete", F.lit(False)))


def fidelity(model: DataFrame, observed: DataFrame, excluded: DataFrame) -> DataFrame:
    """Names on one side only; observed names on the exclusion list are ignored."""
    seen = observed.select("name").distinct().join(excluded.select("name"), "name", "left_anti")
    both = model.select("name").distinct().withColumn("_m", F.lit(True)).join(
        seen.withColumn("_o", F.lit(True)), "name", "full_outer"
    )
    return both.filter("_m is null or _o is null").select(
        "name", F.when(F.col("_o").isNull(), "only_in_model").otherwise("only_in_observed").alias("side")
    )
