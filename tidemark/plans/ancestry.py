"""Registered queries: ancestry over a commit graph derived from the orders."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from ..operators import ancestry as A
from ..operators.prefix import dense_index, running
from ..session import checkpointed
from .registering import Collector
from .views import cte, facts, table

query = Collector()
QUERIES, ORACLES = query.queries, query.oracles

# Commits go on in five lines by customer; every sixty-first one merges what the next line had last.
LINES = 5
GRAPH = cte("facts") + f""", lined AS (SELECT sha, idx, author_id % {LINES} AS line, landed FROM facts),
 firsts AS (SELECT sha, lag(sha) OVER (PARTITION BY line ORDER BY idx) AS parent FROM lined),
 lasts AS (SELECT sha, idx, line, {", ".join(f"max(CASE WHEN line = {line} THEN idx END) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l{line}" for line in range(LINES))} FROM lined),
 merged AS (SELECT a.sha, b.sha AS parent FROM (SELECT sha, CASE (line + 1) % {LINES} {" ".join(f"WHEN {line} THEN l{line}" for line in range(LINES))} END AS other FROM lasts WHERE idx % 61 = 0) a JOIN lined b ON b.idx = a.other),
 parents AS (SELECT sha, parent, 0 AS ord FROM firsts WHERE parent IS NOT NULL UNION ALL SELECT sha, parent, 1 FROM merged),
 tips AS (SELECT max_by(f.sha, f.idx) AS sha FROM facts f JOIN customer ON c_custkey = f.author_id WHERE f.idx % 3 = 0 GROUP BY c_nationkey)"""


def graph(spark, d):
    """(facts, parents, tips) of the derived graph."""
    f = facts(spark, d)
    lined = f.select("sha", "idx", (F.col("author_id") % LINES).alias("line"), "landed")
    # Places along each line, so that the commit before is the one a place lower.
    along = checkpointed(dense_index(lined, ["idx"], out="nth", keys=["line"]))
    before = along.select("line", (F.col("nth") + 1).alias("nth"), F.col("sha").alias("parent"))
    firsts = along.join(before, ["line", "nth"]).select("sha", "parent", F.lit(0).alias("ord"))
    lasts = running(lined, [], "idx", maxes={f"l{line}": F.when(F.col("line") == line, F.col("idx")) for line in range(LINES)})
    other = (F.col("line") + 1) % LINES
    wanted = F.coalesce(*[F.when(other == line, F.col(f"l{line}")) for line in range(LINES)])
    merged = lasts.filter("idx % 61 = 0").select("sha", wanted.alias("idx")).join(lined.select("idx", F.col("sha").alias("parent")), "idx").select("sha", "parent", F.lit(1).alias("ord"))
    nations = table(spark, d, "customer").select(F.col("c_custkey").alias("author_id"), "c_nationkey")
    tips = f.filter("idx % 3 = 0").join(nations, "author_id").groupBy("c_nationkey").agg(F.max_by("sha", "idx").alias("sha"))
    return f, checkpointed(firsts.unionByName(merged)), checkpointed(tips)


@lru_cache(maxsize=1)
def indexed(spark, d):
    """The graph with its index, built once for the queries over one folder."""
    f, parents, tips = graph(spark, d)
    placed = checkpointed(A.chains(parents, f))
    return f, parents, tips, placed, A.reachability(parents, placed)


WALK = GRAPH.replace("WITH", "WITH RECURSIVE", 1) + """, up(start, sha) AS (SELECT sha, sha FROM tips UNION SELECT up.start, p.parent FROM up JOIN parents p ON p.sha = up.sha)"""


@query("j32_ancestor_counts", WALK + " SELECT start AS sha, CAST(count(*) AS BIGINT) AS n_ancestors FROM up GROUP BY start")
def _(spark, d):
    _f, _parents, tips, _placed, index = indexed(spark, d)
    return A.ancestor_counts(index).join(tips.select("sha").distinct(), "sha", "left_semi").select("sha", F.col("n_ancestors").cast("bigint").alias("n_ancestors"))


@query("j32_is_ancestor", WALK + """ SELECT f.sha AS ancestor, t.sha AS "of", u.sha IS NOT NULL AS is_ancestor FROM facts f JOIN customer ON c_custkey = f.author_id
 JOIN (SELECT max_by(f.sha, f.idx) AS sha, c_nationkey FROM facts f JOIN customer ON c_custkey = f.author_id WHERE f.idx % 3 = 0 GROUP BY c_nationkey) t USING (c_nationkey)
 LEFT JOIN up u ON u.start = t.sha AND u.sha = f.sha""")
def _(spark, d):
    f, _parents, tips, placed, index = indexed(spark, d)
    nations = table(spark, d, "customer").select(F.col("c_custkey").alias("author_id"), "c_nationkey")
    pairs = f.join(nations, "author_id").join(tips.withColumnRenamed("sha", "of"), "c_nationkey").select(F.col("sha").alias("ancestor"), "of")
    return A.is_ancestor(pairs, placed, index)


@query("j32_merge_bases", WALK + """ SELECT x.sha AS a, y.sha AS b, (SELECT max_by(f.sha, f.idx) FROM up u JOIN up v ON u.sha = v.sha JOIN facts f ON f.sha = u.sha WHERE u.start = x.sha AND v.start = y.sha) AS base
 FROM (SELECT DISTINCT sha FROM tips) x JOIN (SELECT DISTINCT sha FROM tips) y ON x.sha < y.sha""")
def _(spark, d):
    f, _parents, tips, placed, index = indexed(spark, d)
    one = tips.select(F.col("sha").alias("a")).distinct()
    # At most one tip a nation, so the pairs are as few as pairs of nations.
    pairs = one.join(one.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    return A.merge_bases(pairs, placed, index, f)


@query("j32_first_parent_walk", WALK.replace("JOIN parents p ON p.sha = up.sha)", "JOIN firsts p ON p.sha = up.sha AND p.parent IS NOT NULL)") + """
 SELECT u.start AS tip, u.sha, CAST(row_number() OVER (PARTITION BY u.start ORDER BY f.idx DESC) AS BIGINT) AS nth FROM up u JOIN facts f ON f.sha = u.sha WHERE f.landed >= (SELECT max(landed) - 31536000 FROM facts)""")
def _(spark, d):
    f, parents, tips, placed, _index = indexed(spark, d)
    newest = f.agg(F.max("landed")).first()[0]
    walked = A.first_parent_walk(tips, parents, placed, f.select("sha", "idx", "landed"), since=newest - 31_536_000)
    return walked.withColumn("nth", F.col("nth").cast("bigint"))
