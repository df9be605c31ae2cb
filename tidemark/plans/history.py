"""Registered queries: landing order, history features, labels and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import labels as L
from ..operators import splits as S
from ..operators.prefix import dense_index
from .registering import Collector
from .views import commits, cte, facts, table, view, view_of, with_areas

query = Collector()
QUERIES, ORACLES = query.queries, query.oracles

DAY, YEAR, WEEK = 86400, 365 * 86400, 7 * 86400

REVERT_CTES = """
 firsts AS (SELECT pr_number, min(idx) AS first_idx FROM facts GROUP BY pr_number),
 resolved AS (SELECT r.idx AS revert,
     CASE WHEN c.idx < r.idx THEN c.idx WHEN p.first_idx < r.idx THEN p.first_idx END AS target,
     CASE WHEN c.idx < r.idx THEN 'sha' WHEN p.first_idx < r.idx THEN 'pr' END AS method
   FROM facts r LEFT JOIN facts c ON c.sha = r.reverts_sha LEFT JOIN firsts p ON p.pr_number = r.reverts_pr
   WHERE r.is_revert),
 links AS (SELECT target, min(revert) AS revert, arg_min(method, revert) AS method FROM resolved
   WHERE target IS NOT NULL GROUP BY target)"""

BUG_CTES = """
 fixes AS (SELECT idx, sha AS parent FROM facts WHERE fix_like AND NOT is_merge),
 ranges AS (SELECT f.idx, f.parent, t.path, t.range_start, t.range_end FROM targets t JOIN fixes f ON t.sha = f.parent),
 sizes AS (SELECT idx, sum(range_end - range_start + 1) AS deleted FROM ranges GROUP BY idx),
 blamed AS (SELECT r.idx AS fix, o.origin_sha, s.deleted FROM ranges r JOIN sizes s ON s.idx = r.idx
   JOIN line_origin o ON o.parent = r.parent AND o.path = r.path AND o.line BETWEEN r.range_start AND r.range_end
   WHERE trim(o.text) <> '' AND NOT regexp_full_match(trim(o.text), '[{}()\\[\\];,]*')
     AND NOT starts_with(trim(o.text), '//') AND trim(o.text) <> '#'),
 pairs AS (SELECT c.idx AS introducer, b.fix, b.deleted FROM blamed b JOIN facts c ON c.sha = b.origin_sha WHERE c.idx < b.fix),
 bugs AS (SELECT introducer, min(fix) AS fix, count(DISTINCT fix) AS fix_count FROM pairs GROUP BY introducer)"""

LABEL_CTES = REVERT_CTES + "," + BUG_CTES + """,
 labels0 AS (SELECT f.idx, f.sha, f.landed, f.is_merge,
   CASE WHEN NOT f.is_merge THEN r.landed IS NOT NULL END AS reverted,
   CASE WHEN NOT f.is_merge THEN r.landed END AS reverted_landed,
   CASE WHEN NOT f.is_merge THEN k.method END AS revert_link,
   CASE WHEN NOT f.is_merge THEN round((r.landed - f.landed) / 86400.0::DOUBLE, 3) END AS revert_lead_days,
   CASE WHEN NOT f.is_merge THEN coalesce(t.is_revert, false) END AS revert_nested,
   CASE WHEN NOT f.is_merge THEN coalesce(r.landed - f.landed <= 7 * 86400, false) END AS reverted_within_7d,
   CASE WHEN NOT f.is_merge THEN coalesce(r.landed - f.landed <= 30 * 86400, false) END AS reverted_within_30d,
   CASE WHEN NOT f.is_merge THEN coalesce(r.landed - f.landed <= 90 * 86400, false) END AS reverted_within_90d,
   CASE WHEN NOT f.is_merge AND NOT f.submodule_only AND f.szz_eligible THEN x.landed IS NOT NULL END AS bug_introducing,
   CASE WHEN NOT f.is_merge AND NOT f.submodule_only AND f.szz_eligible THEN x.landed END AS fixed_landed,
   CASE WHEN NOT f.is_merge AND NOT f.submodule_only AND f.szz_eligible
        THEN round((x.landed - f.landed) / 86400.0::DOUBLE, 3) END AS fix_lead_days,
   CASE WHEN NOT f.is_merge AND NOT f.submodule_only AND f.szz_eligible THEN coalesce(b.fix_count, 0) END AS fix_count
   FROM facts f LEFT JOIN links k ON k.target = f.idx LEFT JOIN facts r ON r.idx = k.revert
   LEFT JOIN facts t ON t.idx = k.target
   LEFT JOIN bugs b ON b.introducer = f.idx LEFT JOIN facts x ON x.idx = b.fix)"""

SPLIT_CTES = """
 eligible AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS rn, count(*) OVER () AS n FROM facts
   WHERE landed <= (SELECT max(landed) FROM facts) - 90 * 86400),
 bounds AS (SELECT (SELECT max(landed) FROM facts) AS snapshot,
   (SELECT landed FROM eligible WHERE rn = floor(n * CAST(0.7 AS DOUBLE))) AS v,
   (SELECT landed FROM eligible WHERE rn = floor(n * CAST(0.85 AS DOUBLE))) AS t),
 splits AS (SELECT f.*, CASE WHEN landed > snapshot - 7776000 THEN 'gap'
     WHEN landed < v THEN CASE WHEN landed <= v - 7776000 THEN 'train' ELSE 'gap' END
     WHEN landed < t THEN CASE WHEN landed <= t - 7776000 THEN 'validation' ELSE 'gap' END
     ELSE 'test' END AS split FROM facts f, bounds)"""

AWARE_CTES = LABEL_CTES + "," + SPLIT_CTES + """,
 ended AS (SELECT l.*, s.split, CASE s.split WHEN 'train' THEN v WHEN 'validation' THEN t WHEN 'test' THEN snapshot END AS split_end
   FROM labels0 l JOIN splits s USING (idx), bounds),
 seen AS (SELECT idx, sha, split,
   CASE WHEN split_end IS NOT NULL AND reverted THEN reverted_landed <= split_end ELSE reverted END AS reverted,
   CASE WHEN split_end IS NOT NULL AND bug_introducing THEN fixed_landed <= split_end ELSE bug_introducing END AS bug_introducing,
   reverted_within_7d AS w7, reverted_within_30d AS w30, reverted_within_90d AS w90 FROM ended),
 aware AS (SELECT idx, sha, split, reverted, bug_introducing,
   CASE WHEN w7 THEN coalesce(reverted, false) ELSE w7 END AS reverted_within_7d,
   CASE WHEN w30 THEN coalesce(reverted, false) ELSE w30 END AS reverted_within_30d,
   CASE WHEN w90 THEN coalesce(reverted, false) ELSE w90 END AS reverted_within_90d FROM seen)"""


def bug_pairs(spark, d, f):
    """The blamed pairs of the derived commits; the parent tree of a fix carries the fix's key."""
    fixes = f.filter("fix_like and not is_merge").select("idx", F.col("sha").alias("parent"))
    keys = fixes.withColumnRenamed("parent", "sha")
    targets = view_of(spark, d, "targets", keys).join(keys, "sha").drop("sha")
    return L.attribute_bugs(fixes, targets, view_of(spark, d, "line_origin", keys), f)


def labels_of(spark, d, f):
    return L.commit_labels(f, L.link_reverts(f), L.introducers(bug_pairs(spark, d, f)))


def file_features(spark, d, f):
    """File history of the derived commits: a change goes once to its commit and once to its file."""
    changes = view(spark, d, "changes")
    sizes = changes.groupBy("sha").agg(F.count(F.lit(1)).alias("n_changes"))
    touches = changes.select("sha", F.col("path").alias("lineage"), (F.col("status") != "A").alias("read")).join(f.select("sha", "idx", "author_id", "landed", "fix_like"), "sha")
    return H.file_history(f.join(sizes, "sha", "left").na.fill(0, ["n_changes"]), touches.drop("sha"))


def split_aware(spark, d):
    f = facts(spark, d)
    rows, ends = S.assign_splits(f)
    labelled = labels_of(spark, d, f).join(rows.select("idx", "split"), "idx")
    return L.split_labels(labelled, ends)


@query("w01_landing_index", cte("commits") + " SELECT sha, idx FROM commits")
def _(spark, d):
    return commits(spark, d).select("sha", "idx")


@query("w01_landing_index_per_repo", cte("commits") + """ SELECT sha, sha % 3 AS repo,
 CAST(row_number() OVER (PARTITION BY sha % 3 ORDER BY day, sha) - 1 AS BIGINT) AS idx FROM commits""")
def _(spark, d):
    base = view(spark, d, "commit_base").withColumn("repo", F.expr("sha % 3"))
    return dense_index(base, ["day", "sha"], keys=["repo"]).select("sha", "repo", "idx")


@query("w02_landing_time", cte("facts") + " SELECT sha, idx, landed FROM facts")
def _(spark, d):
    return facts(spark, d).select("sha", "idx", "landed")


@query("w03_author_prior", cte("commits") + """ SELECT sha, CAST(row_number() OVER (PARTITION BY author_id ORDER BY idx) - 1
 AS BIGINT) AS author_prior_commits, row_number() OVER (PARTITION BY author_id ORDER BY idx) = 1 AS author_first_commit
 FROM commits""")
def _(spark, d):
    return H.author_prior(facts(spark, d)).select("sha", "author_prior_commits", "author_first_commit")


@query("w04_author_area_experience", cte("commits", "areas") + """, seen AS (SELECT c.idx,
  count(*) OVER (PARTITION BY c.author_id, a.area ORDER BY c.idx) - 1 AS n FROM commits c JOIN areas a USING (sha))
 SELECT c.sha, CAST(coalesce(max(s.n), 0) AS BIGINT) AS author_area_experience FROM commits c
 LEFT JOIN seen s ON s.idx = c.idx GROUP BY c.sha""")
def _(spark, d):
    f = facts(spark, d)
    areas = with_areas(spark, d, f, "idx", "author_id")
    return H.author_area_experience(f, areas).select("sha", "author_area_experience")


@query("w05_recent_experience", cte("facts") + f""" SELECT a.sha,
 round(coalesce(sum(CAST(1 AS DOUBLE) / (1 + (a.landed - b.landed) // {YEAR})), 0), 6) AS author_recent_experience
 FROM facts a LEFT JOIN facts b ON b.author_id = a.author_id AND b.idx < a.idx GROUP BY a.sha""")
def _(spark, d):
    return H.recent_experience(facts(spark, d)).select("sha", "author_recent_experience")


# From events (idx, path, author_id, fix_like, landed), reads (idx, path) and sizes (idx, n) to the features of each commit.
HISTORY_TAIL = f""" pairs AS (SELECT r.idx, r.path, e.idx AS before, e.author_id, e.fix_like, e.landed FROM reads r
   JOIN ev e ON e.path = r.path AND e.idx < r.idx),
 unions AS (SELECT idx, count(DISTINCT before) AS changes, count(DISTINCT author_id) AS authors,
   count(DISTINCT CASE WHEN fix_like THEN before END) AS fixes FROM pairs GROUP BY idx),
 per_file AS (SELECT idx, path, count(*) AS n, max(landed) AS last FROM pairs GROUP BY idx, path),
 per_commit AS (SELECT p.idx, max(n) AS most, count(*) AS live, avg((f.landed - p.last) / CAST({DAY} AS DOUBLE)) AS age
   FROM per_file p JOIN facts f ON f.idx = p.idx GROUP BY p.idx)
 SELECT f.sha, CAST(coalesce(u.changes, 0) AS BIGINT) AS file_prior_changes,
  CAST(coalesce(p.most, 0) AS BIGINT) AS file_prior_changes_max,
  CAST(coalesce(u.authors, 0) AS BIGINT) AS file_prior_authors,
  CAST(coalesce(u.fixes, 0) AS BIGINT) AS file_prior_fix_touches,
  round(p.age, 3) AS file_days_since_last_change,
  CASE WHEN coalesce(z.n, 0) > 0 THEN round(1 - coalesce(p.live, 0) / CAST(z.n AS DOUBLE), 6) ELSE 0 END AS file_new_share
 FROM facts f LEFT JOIN sizes z ON z.idx = f.idx LEFT JOIN unions u ON u.idx = f.idx
 LEFT JOIN per_commit p ON p.idx = f.idx"""


@query("w07_file_history", cte("facts", "changes") + """,
 ev AS (SELECT f.idx, c.path, c.status, f.author_id, f.fix_like, f.landed FROM changes c JOIN facts f USING (sha)),
 sizes AS (SELECT idx, count(*) AS n FROM ev GROUP BY idx),
 reads AS (SELECT DISTINCT idx, path FROM ev WHERE status <> 'A'),
""" + HISTORY_TAIL)
def _(spark, d):
    return file_features(spark, d, facts(spark, d)).drop("idx")


@query("w08_area_history", cte("facts", "areas") + "," + REVERT_CTES + """,
 touch AS (SELECT f.idx, a.area FROM facts f JOIN areas a USING (sha)),
 undone AS (SELECT k.revert, t.area FROM links k JOIN touch t ON t.idx = k.target),
 events AS (SELECT idx, area, 1 AS c, 0 AS r FROM touch UNION ALL SELECT revert, area, 0, 1 FROM undone),
 sums AS (SELECT idx, area, c, sum(c) OVER w AS prior, sum(r) OVER w AS reverts FROM events
   WINDOW w AS (PARTITION BY area ORDER BY idx RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 per AS (SELECT idx, sum(coalesce(prior, 0)) AS prior, sum(coalesce(reverts, 0)) AS reverts FROM sums WHERE c = 1 GROUP BY idx)
 SELECT f.sha, CAST(coalesce(p.prior, 0) AS BIGINT) AS area_prior_commits,
   CASE WHEN coalesce(p.prior, 0) > 0 THEN round(p.reverts / CAST(p.prior AS DOUBLE), 6) ELSE 0 END AS area_revert_rate
 FROM facts f LEFT JOIN per p ON p.idx = f.idx""")
def _(spark, d):
    f = facts(spark, d)
    areas = with_areas(spark, d, f, "idx")
    links = L.link_reverts(f).select("target", "revert")
    return H.area_history(f, areas, links).drop("idx")


@query("w09_area_burst", cte("facts", "areas") + f""", touch AS (SELECT f.idx, f.landed, a.area FROM facts f JOIN areas a USING (sha)),
 counted AS (SELECT a.idx, a.area, count(b.idx) AS n FROM touch a LEFT JOIN touch b ON b.area = a.area
   AND b.idx < a.idx AND b.landed >= a.landed - {WEEK} GROUP BY a.idx, a.area)
 SELECT f.sha, CAST(coalesce(max(c.n), 0) AS BIGINT) AS area_commits_last_7d FROM facts f
 LEFT JOIN counted c ON c.idx = f.idx GROUP BY f.sha""")
def _(spark, d):
    f = facts(spark, d)
    return H.area_burst(f, with_areas(spark, d, f, "idx", "landed")).drop("idx")


@query("j01_revert_link", cte("facts") + "," + REVERT_CTES + """
 SELECT k.target, k.revert, k.method, t.is_revert AS nested FROM links k JOIN facts t ON t.idx = k.target""")
def _(spark, d):
    return L.link_reverts(commits(spark, d)).select("target", "revert", "method", "nested")


@query("j01_revert_stats", cte("facts") + "," + REVERT_CTES + """
 SELECT count(*) AS reverts, count(*) FILTER (method = 'sha') AS linked_by_sha,
  count(*) FILTER (method = 'pr') AS linked_by_pr, count(*) FILTER (method IS NULL) AS unlinked,
  count(*) FILTER (t.is_revert) AS nested FROM resolved r LEFT JOIN facts t ON t.idx = r.target""")
def _(spark, d):
    return L.revert_stats(commits(spark, d))


@query("p14_blame_targets", cte("changes") + """ SELECT sha,
 bool_or(additions % 3 <> 0 AND NOT is_binary) AS szz_eligible,
 CAST(coalesce(sum(deletions) FILTER (additions % 3 <> 0 AND NOT is_binary AND status <> 'A' AND deletions > 0), 0) AS BIGINT) AS szz_deleted_lines,
 CAST(count(*) FILTER (additions % 3 <> 0 AND NOT is_binary AND status <> 'A' AND deletions > 0) AS BIGINT) AS n_ranges
 FROM changes GROUP BY sha""")
def _(spark, d):
    files = view(spark, d, "changes").select(
        "sha", F.when(F.col("status") != "A", F.col("path")).alias("old_path"), F.col("is_binary").alias("binary"),
        F.expr("CASE additions % 3 WHEN 0 THEN 'doc' WHEN 1 THEN 'code' ELSE 'build' END").alias("file_class"),
        F.array(F.struct(F.lit(1).cast("bigint").alias("old_start"), F.col("deletions").alias("old_count"))).alias("hunks"),
    )
    return L.blame_targets(files, ("code", "config", "build", "yang", "patch"))


@query("p15_meaningful_line", """SELECT conv_id, turn, CAST(count(*) AS BIGINT) AS kept FROM (
 SELECT conv_id, turn, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS t FROM conversations)
 WHERE NOT regexp_full_match(t, '[{}()\\[\\];,]*') AND t <> '#' AND NOT regexp_matches(t, '^(//|/\\*|\\*/|\\* |# |--)')
 GROUP BY conv_id, turn""")
def _(spark, d):
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("t"))
    return lines.filter(L.is_meaningful_line(F.col("t"))).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("kept"))


@query("j05_blame_attribution", cte("facts", "targets", "line_origin") + "," + BUG_CTES + """
 SELECT introducer, fix, count(*) AS lines, CAST(any_value(deleted) AS BIGINT) AS deleted FROM pairs GROUP BY introducer, fix""")
def _(spark, d):
    pairs = bug_pairs(spark, d, facts(spark, d))
    return pairs.groupBy("introducer", "fix").agg(F.count(F.lit(1)).alias("lines"), F.max("deleted").alias("deleted"))


@query("a22_introducers", cte("facts", "targets", "line_origin") + "," + BUG_CTES + """
 SELECT introducer, fix, CAST(fix_count AS BIGINT) AS fix_count FROM bugs""")
def _(spark, d):
    return L.introducers(bug_pairs(spark, d, facts(spark, d)))


@query("j04_commit_labels", cte("facts", "targets", "line_origin") + "," + LABEL_CTES + """
 SELECT sha, reverted, reverted_landed, revert_link, revert_lead_days, revert_nested, reverted_within_7d,
  reverted_within_30d, reverted_within_90d, bug_introducing, fixed_landed, fix_lead_days, CAST(fix_count AS BIGINT) AS fix_count
 FROM labels0""")
def _(spark, d):
    return labels_of(spark, d, facts(spark, d)).drop("idx", "landed", "reverted_by")


@query("m01_time_split", cte("facts") + "," + SPLIT_CTES + " SELECT sha, split FROM splits")
def _(spark, d):
    return S.assign_splits(facts(spark, d))[0].select("sha", "split")


@query("m01_time_split_holdout", cte("facts") + """,
 open_rows AS (SELECT * FROM facts WHERE sha % 101 <> 0),
 eligible AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS rn, count(*) OVER () AS n FROM open_rows
   WHERE landed <= (SELECT max(landed) FROM facts) - 90 * 86400),
 bounds AS (SELECT (SELECT max(landed) FROM facts) AS snapshot,
   (SELECT landed FROM eligible WHERE rn = floor(n * CAST(0.7 AS DOUBLE))) AS v,
   (SELECT landed FROM eligible WHERE rn = floor(n * CAST(0.85 AS DOUBLE))) AS t)
 SELECT sha, CASE WHEN sha % 101 = 0 THEN 'holdout' WHEN landed > snapshot - 7776000 THEN 'gap'
     WHEN landed < v THEN CASE WHEN landed <= v - 7776000 THEN 'train' ELSE 'gap' END
     WHEN landed < t THEN CASE WHEN landed <= t - 7776000 THEN 'validation' ELSE 'gap' END
     ELSE 'test' END AS split FROM facts, bounds""")
def _(spark, d):
    f = facts(spark, d)
    return S.assign_splits(f, f.filter("sha % 101 = 0"))[0].select("sha", "split")


@query("m02_split_labels", cte("facts", "targets", "line_origin") + "," + AWARE_CTES + """ SELECT sha, split, reverted,
 bug_introducing, reverted_within_7d, reverted_within_30d, reverted_within_90d FROM aware""")
def _(spark, d):
    return split_aware(spark, d).select(
        "sha", "split", "reverted", "bug_introducing", "reverted_within_7d", "reverted_within_30d", "reverted_within_90d"
    )


RATES = """ SELECT split, label, CAST(count(*) FILTER (value) AS BIGINT) AS positive, CAST(count(*) AS BIGINT) AS known,
 round(avg(CAST(CAST(value AS INT) AS DOUBLE)), 6) AS rate FROM ({long}) WHERE value IS NOT NULL GROUP BY split, label"""
LONG = " UNION ALL ".join(f"SELECT {{split}} AS split, '{name}' AS label, {name} AS value FROM {{source}}" for name in L.LABELS)


@query("a09_label_rates", cte("facts", "targets", "line_origin") + "," + AWARE_CTES
       + RATES.format(long=LONG.format(split="split", source="aware")))
def label_rates(spark, d):
    return L.positive_rates(split_aware(spark, d))


@query("a09_label_rates_at_snapshot", cte("facts", "targets", "line_origin") + "," + LABEL_CTES
       + RATES.format(long=LONG.format(split="'snapshot'", source="labels0")))
def _(spark, d):
    return L.positive_rates(labels_of(spark, d, facts(spark, d)).withColumn("split", F.lit("snapshot")))


@query("a10_split_counts", cte("facts") + "," + SPLIT_CTES + """ SELECT split, CAST(count(*) AS BIGINT) AS n,
 CAST(count(*) FILTER (is_merge) AS BIGINT) AS merges FROM splits GROUP BY split""")
def _(spark, d):
    rows, _ends = S.assign_splits(facts(spark, d))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_merge").alias("merges"))


@query("j03_unique_prefix", """WITH prefixes AS (SELECT DISTINCT left(sha256(CAST(o_custkey AS VARCHAR)), 7 + CAST(o_custkey % 3 AS INT)) AS prefix
   FROM orders UNION SELECT 'abc' UNION SELECT 'zzzzzzzz'),
 keys AS (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS k FROM orders)
 SELECT p.prefix, CASE WHEN length(p.prefix) >= 7 THEN CAST(count(k.k) AS BIGINT) END AS matches, CASE WHEN count(k.k) = 1 THEN min(k.k) END AS key, length(p.prefix) < 7 AS too_short
 FROM prefixes p LEFT JOIN keys k ON length(p.prefix) >= 7 AND starts_with(k.k, p.prefix) GROUP BY p.prefix""")
def _(spark, d):
    orders = table(spark, d, "orders")
    keys = orders.select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("k"))
    prefixes = orders.select(
        F.expr("left(sha2(CAST(o_custkey AS STRING), 256), 7 + CAST(o_custkey % 3 AS INT))").alias("prefix")
    ).unionByName(spark.createDataFrame([("abc",), ("zzzzzzzz",)], "prefix string"))
    # What is too short was not counted, so the report names no number.
    return S.resolve_prefixes(keys, "k", prefixes).withColumn("matches", F.when(~F.col("too_short"), F.col("matches")))


@query("j17_incremental_antijoin", """SELECT o_orderkey AS sha, CAST(1 AS BIGINT) AS fresh FROM orders
 WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""")
def _(spark, d):
    from ..operators.ledger import missing_keys

    cached = table(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("sha"))
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("sha"))
    return missing_keys(wanted, cached, ["sha"]).withColumn("fresh", F.lit(1).cast("bigint"))
