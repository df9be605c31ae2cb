"""Registered queries: CI results, label join, path priors, reach and rule scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.paths import PathRules, Rule, extension
from ..operators import ci as C
from ..operators import splits as S
from ..session import checkpointed
from .registering import Collector
from .views import commits, cte, table, view

query = Collector()
QUERIES, ORACLES = query.queries, query.oracles

RULES = PathRules((
    Rule("core", exact=("p/0/0",), prefixes=("p/1/", "p/2/")),
    Rule("device", prefixes=("p/3",)),
    Rule("seven", contains=("/77",)),
    Rule("tail9", regex=("9$",)),
))
BUCKET = """CASE WHEN path = 'p/0/0' OR starts_with(path, 'p/1/') OR starts_with(path, 'p/2/') THEN 'core'
 WHEN starts_with(path, 'p/3') THEN 'device' WHEN contains(path, '/77') THEN 'seven'
 WHEN regexp_matches(path, '9$') THEN 'tail9' ELSE 'other' END"""
GOLD = ("click", "view", "purchase", "error")
REACH = C.Reach(
    gold=GOLD, pretest=("view",), all_gold_buckets=("core",),
    vendors=(("p/3", {"31": ("gold",), "32": ("pretest", "error")}),),
    bucket_jobs={"seven": ("purchase", "pretest")}, tests_prefix="p/5", feature_jobs={"5": ("error",)},
)
JOBS = f"""CASE WHEN {BUCKET} = 'core' THEN ['click', 'view', 'purchase', 'error']
 WHEN starts_with(path, 'p/3') AND split_part(path, '/', 2) = '31' THEN ['click', 'view', 'purchase', 'error']
 WHEN starts_with(path, 'p/3') AND split_part(path, '/', 2) = '32' THEN ['view', 'error']
 WHEN {BUCKET} = 'seven' THEN ['purchase', 'view']
 WHEN starts_with(path, 'p/5') THEN CASE WHEN split_part(path, '/', 2) = '5' THEN ['view', 'error']
   ELSE ['view', 'click', 'purchase', 'error'] END ELSE ['view'] END"""
SCORE = C.ScoreRules(
    cap=0.35, skip_mark="/3/", skip_cap=1.3, boost_buckets=("core", "tail9"), boost_jobs=("click", "view"),
    boost=1.15, bucket_priors={"core": 0.05, "seven": 0.2},
)
MIN_TOUCHES = 1

LABEL_CTES = """
 anys AS (SELECT pr, job, CASE WHEN bool_or(result = 'failed') THEN 'failed'
   WHEN bool_or(result = 'succeeded') THEN 'succeeded'
   ELSE arg_max(result, (finish, build)) FILTER (result IS NOT NULL) END AS result FROM job_results GROUP BY pr, job),
 lasts AS (SELECT pr, max(finish) AS finish FROM job_results GROUP BY pr),
 ordered AS (SELECT pr, row_number() OVER (ORDER BY finish, pr) - 1 AS rn, count(*) OVER () AS n FROM lasts),
 prsplit AS (SELECT pr, CASE WHEN rn < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
   WHEN rn < floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'valid' ELSE 'test' END AS split FROM ordered),
 labelled AS (SELECT a.*, s.split FROM anys a JOIN prsplit s USING (pr))"""

FILE_CTES = f"""
 squash AS (SELECT c.author_id AS pr, c.idx, h.path, h.additions, h.deletions, h.is_binary AS binary
   FROM changes h JOIN commits c USING (sha) WHERE c.fix_like),
 fetched AS (SELECT l_suppkey AS pr, CASE l_suppkey % 3 WHEN 0 THEN 'pull_two_dot' ELSE 'merge_base' END AS source,
   concat('p/', l_partkey % 40, '/', l_partkey) AS path, CAST(l_quantity AS BIGINT) AS additions,
   CAST(l_discount * 100 AS BIGINT) AS deletions, l_partkey % 50 = 0 AS binary FROM lineitem),
 firstc AS (SELECT pr, min(idx) AS idx FROM squash GROUP BY pr),
 other AS (SELECT pr, max(source) AS source FROM fetched GROUP BY pr),
 prs AS (SELECT r.pr, c.idx, CASE WHEN c.idx IS NOT NULL THEN 'squash' ELSE coalesce(o.source, 'unresolved') END AS source
   FROM (SELECT DISTINCT pr FROM job_results) r LEFT JOIN firstc c ON c.pr = r.pr LEFT JOIN other o ON o.pr = r.pr),
 tagged AS (SELECT pr, idx, source, source NOT IN ('unresolved', 'pull_two_dot') AS usable FROM prs),
 prfiles AS (SELECT p.pr, p.usable, s.path, s.additions, s.deletions, s.binary FROM tagged p JOIN squash s ON s.pr = p.pr AND s.idx = p.idx
   UNION ALL SELECT p.pr, p.usable, f.path, f.additions, f.deletions, f.binary FROM tagged p JOIN fetched f ON f.pr = p.pr WHERE p.idx IS NULL)"""

RATE_CTES = f"""
 base AS (SELECT count(*) FILTER (is_revert) / CAST(count(*) AS DOUBLE) AS b FROM commits),
 rates AS (SELECT path, touches, reverts, round(reverts / CAST(touches AS DOUBLE), 6) AS p_revert,
    round(reverts / CAST(touches AS DOUBLE) * 100, 3) AS p_revert_pct,
    round(reverts / CAST(touches AS DOUBLE) / b, 3) AS lift_vs_base, {BUCKET} AS bucket
   FROM (SELECT path, count(*) AS touches, count(*) FILTER (is_revert) AS reverts
     FROM changes JOIN commits USING (sha) GROUP BY path), base WHERE touches >= {MIN_TOUCHES}),
 model_files AS (SELECT f.pr, f.path, f.additions, f.deletions, f.binary, {BUCKET.replace('path', 'f.path')} AS bucket,
   coalesce(r.p_revert, CASE {BUCKET.replace('path', 'f.path')} WHEN 'core' THEN 0.05::DOUBLE WHEN 'seven' THEN 0.2::DOUBLE ELSE b END) AS prior
   FROM prfiles f LEFT JOIN rates r ON r.path = f.path, base WHERE f.usable)"""

JOB_BASE_CTES = """
 jobbase AS (SELECT j.job, coalesce(count(*) FILTER (split = 'train' AND result = 'failed')
     / nullif(CAST(count(*) FILTER (split = 'train' AND result IN ('failed', 'succeeded')) AS DOUBLE), 0), any_value(b)) AS base
   FROM (SELECT unnest(['click', 'view', 'purchase', 'error']) AS job) j LEFT JOIN labelled l ON l.job = j.job, base GROUP BY j.job)"""


def results(spark, d):
    return view(spark, d, "job_results")


def labelled(spark, d):
    r = results(spark, d)
    runs = r.groupBy("pr").agg(F.max("finish").alias("finish"))
    return C.any_attempt(r).join(S.entity_split(runs, "pr", "finish").select("pr", "split"), "pr")


def bags(spark, d):
    """(PRs with source and usability, their files). An urgent commit stands for a landed PR of its author."""
    c = commits(spark, d).filter("fix_like").select("sha", "idx", "author_id")
    squash = view(spark, d, "changes").join(c, "sha").select(
        F.col("author_id").alias("pr"), "idx", "path", "additions", "deletions", F.col("is_binary").alias("binary"))
    fetched = table(spark, d, "lineitem").selectExpr(
        "l_suppkey AS pr", "CASE l_suppkey % 3 WHEN 0 THEN 'pull_two_dot' ELSE 'merge_base' END AS source",
        "concat('p/', l_partkey % 40, '/', l_partkey) AS path", "CAST(l_quantity AS BIGINT) AS additions",
        "CAST(l_discount * 100 AS BIGINT) AS deletions", "l_partkey % 50 = 0 AS binary")
    return C.pr_files(results(spark, d), squash, fetched)


def rates(spark, d):
    return C.revert_rates(view(spark, d, "changes"), view(spark, d, "commit_base"), RULES, MIN_TOUCHES)


def base_rate(spark, d):
    return view(spark, d, "commit_base").agg(F.count_if("is_revert") / F.count(F.lit(1))).scalar()


def model_files(spark, d):
    prs, files = bags(spark, d)
    usable = files.join(prs.filter("usable").select("pr"), "pr", "left_semi")
    return prs, C.priors_of(usable, rates(spark, d), RULES, SCORE.bucket_priors, base_rate(spark, d))


def scores(spark, d):
    prs, files = model_files(spark, d)
    base = C.job_base_rates(labelled(spark, d), GOLD, base_rate(spark, d))
    return C.rule_scores(prs, files, base, REACH, SCORE, base_rate(spark, d))


@query("p03_path_bucket", cte("changes") + f" SELECT DISTINCT path, {BUCKET} AS bucket FROM changes")
def _(spark, d):
    return view(spark, d, "changes").select("path").distinct().withColumn("bucket", RULES.name(F.col("path")))


@query("p09_path_flags", cte("changes") + """ SELECT sha, bool_or(path = 'p/0/0' OR contains(path, '/77')) AS touches_hot,
 bool_or(starts_with(path, 'p/3')) AS touches_device, CAST(count(*) FILTER (starts_with(path, 'p/3')) AS BIGINT) AS n_device
 FROM changes GROUP BY sha""")
def _(spark, d):
    hot, device = Rule("hot", exact=("p/0/0",), contains=("/77",)), Rule("device", prefixes=("p/3",))
    path = F.col("path")
    return view(spark, d, "changes").groupBy("sha").agg(
        F.bool_or(hot.test(path)).alias("touches_hot"), F.bool_or(device.test(path)).alias("touches_device"),
        F.count_if(device.test(path)).alias("n_device"))


@query("p12_usable_path_bag", """SELECT source, coalesce(s, '<null>') AS tag, CAST(count(*) AS BIGINT) AS n,
 coalesce(s NOT IN ('', 'unresolved', 'fetch_failed', 'diff_failed') AND NOT contains(s, 'two_dot'), false) AS usable FROM
 (SELECT source, CASE n_chars % 6 WHEN 0 THEN NULL WHEN 1 THEN 'x_two_dot' WHEN 2 THEN 'unresolved' WHEN 3 THEN 'diff_failed'
   WHEN 4 THEN '' ELSE source END AS s FROM documents) GROUP BY source, s""")
def _(spark, d):
    tag = F.expr("""CASE n_chars % 6 WHEN 0 THEN NULL WHEN 1 THEN 'x_two_dot' WHEN 2 THEN 'unresolved'
        WHEN 3 THEN 'diff_failed' WHEN 4 THEN '' ELSE source END""")
    return table(spark, d, "documents").select("source", F.coalesce(tag, F.lit("<null>")).alias("tag")).groupBy("source", "tag").agg(
        F.count(F.lit(1)).alias("n")).withColumn("usable", C.path_usable(F.expr("nullif(tag, '<null>')")))


@query("p13_submodule_pointer_only", """SELECT l_orderkey AS pr, bool_and(path = '.gitmodules' OR (regexp_full_match(path, 'src/[^/]+')
 AND coalesce(a, 0) IN (0, 1) AND coalesce(x, 0) IN (0, 1))) AS submodule_only FROM (SELECT l_orderkey,
 CASE l_partkey % 3 WHEN 0 THEN '.gitmodules' WHEN 1 THEN concat('src/', l_partkey) ELSE concat('src/m/', l_partkey) END AS path,
 CAST(l_quantity AS BIGINT) % 2 AS a, CASE WHEN l_tax > 0.04 THEN CAST(l_discount * 100 AS BIGINT) % 3 END AS x FROM lineitem) GROUP BY l_orderkey""")
def _(spark, d):
    files = table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS pr", """CASE l_partkey % 3 WHEN 0 THEN '.gitmodules' WHEN 1 THEN concat('src/', l_partkey)
        ELSE concat('src/m/', l_partkey) END AS path""", "CAST(l_quantity AS BIGINT) % 2 AS additions",
        "CASE WHEN l_tax > 0.04 THEN CAST(l_discount * 100 AS BIGINT) % 3 END AS deletions")
    return C.only_submodule_pointers(files)


@query("w10_attempt_selection", cte("job_results") + """, newest AS (SELECT pr, max((finish, build)) AS last FROM job_results GROUP BY pr
  ORDER BY last DESC LIMIT 60)
 SELECT pr, build, finish FROM (SELECT r.*, row_number() OVER (PARTITION BY pr ORDER BY finish DESC, build DESC) AS n
  FROM job_results r WHERE pr IN (SELECT pr FROM newest)) WHERE n <= 4""")
def _(spark, d):
    return C.select_attempts(results(spark, d), 60, 4).select("pr", "build", "finish")


@query("s08_slim_build", """SELECT event_id AS id, CASE WHEN value > 200 THEN 'failed' ELSE 'succeeded' END AS result,
 CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'refs/heads/main' WHEN 2 THEN 'refs/pull/x9/merge' ELSE concat('refs/pull/', user_id, '/merge') END AS "sourceBranch",
 concat('v', event_id) AS "sourceVersion", CASE WHEN event_id % 4 = 3 THEN user_id END AS pr,
 '2024-01-01T00:00:00Z' AS "finishTime", CAST(NULL AS VARCHAR) AS "startTime" FROM events""")
def _(spark, d):
    raw = table(spark, d, "events").select(F.to_json(F.struct(
        F.col("event_id").alias("id"), F.expr("CASE WHEN value > 200 THEN 'failed' ELSE 'succeeded' END").alias("result"),
        F.expr("""CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'refs/heads/main' WHEN 2 THEN 'refs/pull/x9/merge'
            ELSE concat('refs/pull/', user_id, '/merge') END""").alias("sourceBranch"),
        F.concat(F.lit("v"), "event_id").alias("sourceVersion"), F.lit("2024-01-01T00:00:00Z").alias("finishTime"),
        F.col("props").alias("unused"))).alias("raw"))
    return C.slim_builds(raw)


@query("s09_timeline", """SELECT build, "group", key, arg_max(result, pos) AS result FROM (
 SELECT event_id AS build, pos, CASE WHEN n = 'click' THEN 'image' ELSE 'test' END AS "group", concat('k_', n) AS key, result FROM (
  SELECT event_id, 0 AS pos, event_type AS n, CASE WHEN value > 200 THEN 'failed' ELSE 'succeeded' END AS result FROM events
  UNION ALL SELECT event_id, 2, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'view' ELSE 'unmapped' END,
   CASE WHEN value < 50 THEN 'canceled' END FROM events)
 WHERE n IN ('click', 'view', 'error') AND result IS NOT NULL) GROUP BY ALL""")
def _(spark, d):
    raw = table(spark, d, "events").select(F.col("event_id").alias("build"), F.to_json(F.struct(F.array(
        F.struct(F.lit("Job").alias("type"), F.col("event_type").alias("name"),
                 F.expr("CASE WHEN value > 200 THEN 'failed' ELSE 'succeeded' END").alias("result")),
        F.struct(F.lit("Stage").alias("type"), F.col("event_type").alias("name"), F.lit("failed").alias("result")),
        F.struct(F.lit("Job").alias("type"),
                 F.expr("CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'view' ELSE 'unmapped' END").alias("name"),
                 F.expr("CASE WHEN value < 50 THEN 'canceled' END").alias("result")),
    ).alias("records"))).alias("raw"))
    job_map = spark.createDataFrame(
        [("click", "image", "k_click"), ("view", "test", "k_view"), ("error", "test", "k_error")],
        "name string, group string, key string")
    return C.timeline_jobs(raw, job_map)


@query("a02_any_attempt_label", cte("job_results") + "," + LABEL_CTES + " SELECT pr, job, result FROM anys")
def _(spark, d):
    return C.any_attempt(results(spark, d))


@query("a03_attempt_counts", cte("job_results") + """, per AS (SELECT pr, count(DISTINCT build) AS n_attempts,
  arg_max(build, (finish, build)) AS last_build FROM job_results GROUP BY pr)
 SELECT r.pr, r.job, CAST(n_attempts AS BIGINT) AS n_attempts, last_build,
  CAST(count(*) FILTER (result = 'failed') AS BIGINT) AS fail_attempts,
  max(CASE WHEN build = last_build THEN result END) AS latest FROM job_results r JOIN per USING (pr) GROUP BY ALL""")
def _(spark, d):
    return C.attempt_counts(results(spark, d))


@query("m03_entity_split", cte("job_results") + "," + LABEL_CTES + " SELECT pr, split FROM prsplit")
def _(spark, d):
    runs = results(spark, d).groupBy("pr").agg(F.max("finish").alias("finish"))
    return S.entity_split(runs, "pr", "finish").select("pr", "split")


@query("a04_job_base_rate", cte("commits", "job_results") + "," + LABEL_CTES + ", " + RATE_CTES.split(" rates AS")[0].rstrip(" ,\n")
       + "," + JOB_BASE_CTES + " SELECT job, round(base, 6) AS base FROM jobbase")
def _(spark, d):
    base = C.job_base_rates(labelled(spark, d), GOLD, base_rate(spark, d))
    return base.select("job", F.round("base", 6).alias("base"))


@query("a05_path_job_failures", cte("commits", "changes", "job_results") + "," + LABEL_CTES + "," + FILE_CTES + """
 SELECT path, job, CAST(n AS BIGINT) AS n, CAST(fail AS BIGINT) AS fail, round(fail / CAST(n AS DOUBLE), 4) AS p_fail FROM (
  SELECT f.path, l.job, count(*) AS n, count(*) FILTER (l.result = 'failed') AS fail FROM prfiles f JOIN labelled l ON l.pr = f.pr
   WHERE l.split = 'train' AND l.result IN ('succeeded', 'failed') GROUP BY ALL)""")
def _(spark, d):
    return C.path_job_failures(bags(spark, d)[1], labelled(spark, d))


@query("a10_job_outcome_counts", cte("job_results") + "," + LABEL_CTES + """ SELECT job,
 CAST(count(*) FILTER (result = 'succeeded') AS BIGINT) AS succeeded, CAST(count(*) FILTER (result = 'failed') AS BIGINT) AS failed,
 CAST(count(*) FILTER (result NOT IN ('succeeded', 'failed')) AS BIGINT) AS other,
 CAST(count(*) FILTER (result IS NULL) AS BIGINT) AS missing FROM anys GROUP BY job""")
def _(spark, d):
    r = F.col("result")
    return C.any_attempt(results(spark, d)).groupBy("job").agg(
        F.count_if(r == "succeeded").alias("succeeded"), F.count_if(r == "failed").alias("failed"),
        F.count_if(~r.isin("succeeded", "failed")).alias("other"), F.count_if(r.isNull()).alias("missing"))


@query("j07_ci_outcome_files", cte("commits", "changes", "job_results") + "," + FILE_CTES + """
 SELECT t.pr, t.source, t.usable, CAST(count(f.path) AS BIGINT) AS n_files, CAST(coalesce(sum(f.additions), 0) AS BIGINT) AS additions
 FROM tagged t LEFT JOIN prfiles f ON f.pr = t.pr GROUP BY ALL""")
def _(spark, d):
    prs, files = bags(spark, d)
    sums = files.groupBy("pr").agg(F.count("path").alias("n_files"), F.sum("additions").alias("additions"))
    return prs.join(sums, "pr", "left").na.fill(0, ["n_files", "additions"])


@query("j08_path_reach", cte("changes") + f""" SELECT path, unnest({JOBS}) AS job FROM (SELECT DISTINCT path FROM changes)""")
def _(spark, d):
    paths = view(spark, d, "changes").select("path").distinct()
    return paths.select("path", F.explode(REACH.jobs(F.col("path"), RULES.name(F.col("path")))).alias("job"))


@query("a01_path_revert_rate", cte("commits", "changes") + "," + RATE_CTES.split(" model_files AS")[0].rstrip(" ,\n") + " SELECT * FROM rates")
def _(spark, d):
    return rates(spark, d)


@query("a06_pr_features", cte("commits", "changes", "job_results") + "," + FILE_CTES + "," + RATE_CTES + """
 SELECT pr, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions,
  CAST(sum(additions) + sum(deletions) AS BIGINT) AS churn, CAST(count(*) FILTER ("binary") AS BIGINT) AS binary_files,
  round(ln(1 + sum(additions) + sum(deletions)), 4) AS log1p_churn, round(ln(1 + count(*)), 4) AS log1p_files,
  CAST(count(*) FILTER (bucket = 'core') AS BIGINT) AS n_shared_paths,
  round(count(*) FILTER (bucket = 'core') / CAST(count(*) AS DOUBLE), 4) AS frac_shared,
  round(max(prior), 6) AS max_revert_prior, floor((2 * sum(CAST(round(prior * 1e6) AS BIGINT)) + count(*))::DOUBLE / (2 * count(*))::DOUBLE) / 1e6 AS mean_revert_prior,
  CAST(count(*) FILTER (starts_with(path, 'p/3')) AS BIGINT) AS n_device_paths, bool_or(contains(path, '/77')) AS has_77
 FROM model_files GROUP BY pr""")
def _(spark, d):
    return C.pr_features(model_files(spark, d)[1], "core", {"n_device_paths": "p/3"}, {"has_77": F.col("path").contains("/77")})


@query("a06_bucket_histogram", cte("commits", "changes", "job_results") + "," + FILE_CTES + "," + RATE_CTES + """
 SELECT pr, bucket, CAST(count(*) AS BIGINT) AS n FROM model_files GROUP BY ALL""")
def _(spark, d):
    return C.histogram(model_files(spark, d)[1], F.col("bucket")).select("pr", F.explode("histogram").alias("bucket", "n"))


@query("f26_extension_histogram", """SELECT n_chars % 500 AS pr, e AS extension, CAST(count(*) AS BIGINT) AS n FROM (
 SELECT n_chars, CASE doc_id % 4 WHEN 0 THEN '(none)' WHEN 1 THEN '(none)' WHEN 2 THEN lang ELSE 'gz' END AS e FROM documents) GROUP BY ALL""")
def _(spark, d):
    path = F.expr("""CASE doc_id % 4 WHEN 0 THEN concat('a.b/', source) WHEN 1 THEN concat('x/.', lang)
        WHEN 2 THEN concat('x/y.', upper(lang)) ELSE concat(source, '.tar.gz') END""")
    files = table(spark, d, "documents").select(F.expr("n_chars % 500").alias("pr"), path.alias("path"))
    return C.histogram(files, C.extension_or_none(F.col("path"))).select("pr", F.explode("histogram").alias("extension", "n"))


SCORE_CTES = f""" lifts AS (SELECT pr, job, max(least(prior, CASE WHEN contains(path, '/3/') THEN b * CAST(1.3 AS DOUBLE) ELSE prior END) / b
    * CASE WHEN bucket IN ('core', 'tail9') AND job IN ('click', 'view') THEN CAST(1.15 AS DOUBLE) ELSE 1 END) AS lift
   FROM (SELECT pr, path, bucket, prior, unnest({JOBS}) AS job FROM model_files), base GROUP BY pr, job),
 hscores AS (SELECT p.pr, j.job, round(least(j.base * greatest(1.0::DOUBLE, coalesce(l.lift, 1)), CAST(0.35 AS DOUBLE)), 6) AS heuristic_p
   FROM tagged p CROSS JOIN jobbase j LEFT JOIN lifts l ON l.pr = p.pr AND l.job = j.job)"""


@query("a23_rule_score", cte("commits", "changes", "job_results") + "," + LABEL_CTES + "," + FILE_CTES + "," + RATE_CTES + "," + JOB_BASE_CTES
       + "," + SCORE_CTES + " SELECT pr, job, heuristic_p FROM hscores")
def _(spark, d):
    return scores(spark, d)


@query("a24_fallback_scope", cte("commits", "changes", "job_results") + "," + FILE_CTES + "," + RATE_CTES + """,
 hot AS (SELECT pr, path FROM (SELECT pr, path, row_number() OVER (PARTITION BY pr ORDER BY max(additions) DESC, path) AS n FROM model_files GROUP BY pr, path) WHERE n <= 3)
 SELECT DISTINCT pr, path, true AS files_complete FROM model_files WHERE pr % 4 <> 0 UNION ALL SELECT pr, path, false FROM hot WHERE pr % 4 = 0""")
def _(spark, d):
    files = checkpointed(model_files(spark, d)[1].groupBy("pr", "path").agg(F.max("additions").alias("additions")))
    # Briefs keep the three largest files; the diffs of a quarter of the PRs are gone.
    nth = F.row_number().over(Window.partitionBy("pr").orderBy(F.desc("additions"), "path"))
    hotspots = files.withColumn("n", nth).filter("n <= 3")
    return C.scored_scope(files, files.filter("pr % 4 <> 0"), hotspots)


@query("a24_score_reasons", cte("commits", "changes", "job_results") + "," + FILE_CTES + "," + RATE_CTES + f"""
 SELECT DISTINCT pr, path, bucket, CASE WHEN starts_with(path, 'p/1') THEN 'wide' ELSE 'narrow' END AS path_class,
  round(prior, 6) AS prior, array_to_string({JOBS}, ',') AS jobs FROM model_files""")
def _(spark, d):
    from ..functions.paths import first_match, shell_glob

    path_class = first_match(F.col("path"), [(shell_glob("p/1*"), "wide")], "narrow")
    reasons = C.score_reasons(model_files(spark, d)[1], REACH, path_class)
    return reasons.select("pr", "path", "bucket", "path_class", F.round("prior", 6).alias("prior"),
                          F.array_join("jobs", ",").alias("jobs")).distinct()


@query("a10_class_balance", cte("job_results") + "," + LABEL_CTES + """ SELECT CAST(count(DISTINCT pr) AS BIGINT) AS prs,
 CAST(count(DISTINCT CASE WHEN result = 'failed' THEN pr END) AS BIGINT) AS prs_with_fail,
 CAST(count(*) FILTER (result IN ('succeeded', 'failed')) AS BIGINT) AS pr_job_rows,
 CAST(count(*) FILTER (result = 'failed') AS BIGINT) AS pr_job_positives,
 CAST(count(*) FILTER (result NOT IN ('succeeded', 'failed')) AS BIGINT) AS canceled,
 CAST(count(*) FILTER (result IS NULL) AS BIGINT) AS missing FROM anys WHERE job <> 'signup'""")
def _(spark, d):
    r = F.col("result")
    return C.any_attempt(results(spark, d)).filter(F.col("job").isin(*GOLD)).agg(
        F.count_distinct("pr").alias("prs"), F.count_distinct(F.when(r == "failed", F.col("pr"))).alias("prs_with_fail"),
        F.count_if(r.isin("succeeded", "failed")).alias("pr_job_rows"), F.count_if(r == "failed").alias("pr_job_positives"),
        F.count_if(~r.isin("succeeded", "failed")).alias("canceled"), F.count_if(r.isNull()).alias("missing"))


@query("j20_fidelity_diff", """SELECT coalesce(m.name, o.name) AS name, CASE WHEN o.name IS NULL THEN 'only_in_model' ELSE 'only_in_observed' END AS side
 FROM (SELECT DISTINCT concat('B', p_size) AS name FROM part WHERE p_size % 2 = 0) m
 FULL OUTER JOIN (SELECT DISTINCT concat('B', CAST(l_quantity AS INT)) AS name FROM lineitem
   WHERE CAST(l_quantity AS INT) NOT IN (7, 8)) o ON m.name = o.name WHERE m.name IS NULL OR o.name IS NULL""")
def _(spark, d):
    model = table(spark, d, "part").filter("p_size % 2 = 0").selectExpr("concat('B', p_size) AS name")
    seen = table(spark, d, "lineitem").selectExpr("concat('B', CAST(l_quantity AS INT)) AS name")
    return C.fidelity(model, seen, spark.createDataFrame([("B7",), ("B8",)], "name string"))


@query("j28_local_patch_overlap", cte("commit_base", "changes") + """ SELECT sha, CAST(count(DISTINCT path) AS BIGINT) AS shared FROM changes JOIN commit_base USING (sha)
 WHERE fix_like AND path IN (SELECT path FROM changes JOIN commit_base USING (sha) WHERE is_revert) GROUP BY sha""")
def _(spark, d):
    from ..operators.backtest import patch_overlap

    changes = view(spark, d, "changes").join(view(spark, d, "commit_base"), "sha")
    return patch_overlap(changes.filter("fix_like"), changes.filter("is_revert"))


@query("f15_extension", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN lang ELSE 'gz' END AS ext FROM documents""")
def _(spark, d):
    path = F.expr("""CASE doc_id % 4 WHEN 0 THEN concat('a.b/', source) WHEN 1 THEN concat('x/.', lang)
        WHEN 2 THEN concat('x/y.', upper(lang)) ELSE concat(source, '.tar.gz') END""")
    return table(spark, d, "documents").select("doc_id", extension(path).alias("ext"))
