"""Registered queries: incidents, controls, ground truth, grading, checks of answers and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import log_count, logit, missing, platt
from ..operators import backtest as B
from ..operators import checks as K
from ..operators import features as W
from ..operators import history as H
from ..operators.prefix import running
from ..session import checkpointed
from .features import history_families
from .history import SPLIT_CTES
from .registering import Collector
from .views import commits, cte, facts, table, view

query = Collector()
QUERIES, ORACLES = query.queries, query.oracles

STORY = """SELECT md5(CAST(o_orderkey AS {S})) AS sha, o_orderkey AS k, {E} AS committed_epoch, CAST(1 + CASE WHEN o_orderkey % 41 = 0 THEN 1 ELSE 0 END AS INT) AS n_parents,
 CASE WHEN o_orderkey % 29 = 0 THEN concat('Revert "', CASE WHEN o_orderkey % 58 = 0 THEN 'Revert "' ELSE '' END, 'Change ', o_orderkey - 1 - o_orderkey % 97,
   CASE WHEN o_orderkey % 87 = 0 THEN '…' ELSE '' END, '"', CASE WHEN o_orderkey % 4 = 0 THEN concat(' (#', o_orderkey, ')') ELSE '' END)
  WHEN o_orderkey % 113 = 0 THEN 'Late revert of things' ELSE concat('Change ', o_orderkey) END AS subject,
 CASE WHEN o_orderkey % 29 = 0 AND o_orderkey % 3 = 0 THEN concat('x This reverts commit ', left(md5(CAST(o_orderkey - 1 - o_orderkey % 97 AS {S})), 12 + CAST(o_orderkey % 20 AS INT)), '.',
   CASE WHEN o_orderkey % 2 = 0 THEN concat(' This reverts commit ', md5(CAST(o_orderkey AS {S})), '.') ELSE '' END) ELSE '' END AS body FROM orders"""
DUCK_STORY = STORY.replace("{S}", "VARCHAR").replace("{E}", "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * CAST(86400 AS BIGINT) + o_orderkey % 86400")
INCIDENTS = f"""WITH story AS ({DUCK_STORY}), reverts AS (SELECT *, regexp_extract_all(body, 'This reverts commit ([0-9a-f]{{7,40}})', 1) AS named FROM story WHERE k % 29 = 0),
 pre AS (SELECT DISTINCT named[1] AS p FROM reverts WHERE len(named) > 0), keyed AS (SELECT p, min(s.sha) AS cause, count(*) AS n FROM pre JOIN story s ON starts_with(s.sha, p) GROUP BY p),
 inc AS (SELECT r.sha AS revert_sha, r.subject AS revert_subject, r.committed_epoch AS revert_epoch, TRY_CAST(nullif(regexp_extract(r.subject, '\\(#(\\d+)\\)\\s*$', 1), '') AS BIGINT) AS pr_number,
   regexp_matches(r.subject, '^Revert\\s+"Revert') AS is_nested, CASE WHEN len(named) = 0 THEN 'unlinked' WHEN c.sha IS NULL THEN 'unresolved' ELSE 'linked' END AS link_status,
   coalesce(c.sha, named[1]) AS reverted_sha, c.committed_epoch AS cause_epoch, CAST(greatest(len(named) - 1, 0) AS BIGINT) AS n_additional,
   CAST(floor((r.committed_epoch - c.committed_epoch) / CAST(86400 AS DOUBLE)) AS BIGINT) AS lead_time_days
  FROM reverts r LEFT JOIN keyed y ON y.p = named[1] AND y.n = 1 LEFT JOIN story c ON c.sha = y.cause)"""


def story(spark, d):
    text = STORY.replace("{S}", "STRING").replace("{E}", "datediff(o_orderdate, DATE'1970-01-01') * CAST(86400 AS BIGINT) + o_orderkey % 86400")
    return spark.sql(text.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


def incidents(spark, d):
    s = story(spark, d)
    # Funnels and screens read the incidents several times.
    return checkpointed(B.mine_incidents(s.filter("k % 29 = 0"), s))


@query("j02_incidents", INCIDENTS + " SELECT * FROM inc")
def _(spark, d):
    return incidents(spark, d)


@query("a11_incident_summary", INCIDENTS + """ SELECT CAST(count(*) AS BIGINT) AS reverts, CAST(count(*) FILTER (link_status = 'linked') AS BIGINT) AS linked, CAST(count(*) FILTER (link_status = 'unlinked') AS BIGINT) AS unlinked,
 CAST(count(*) FILTER (link_status = 'unresolved') AS BIGINT) AS unresolved, CAST(count(*) FILTER (is_nested) AS BIGINT) AS nested_reverts, CAST(count(pr_number) AS BIGINT) AS with_pr_number,
 CAST(count(lead_time_days) AS BIGINT) AS lead_count, CAST(count(*) FILTER (lead_time_days < 0) AS BIGINT) AS lead_negative, min(lead_time_days) AS lead_min, max(lead_time_days) AS lead_max,
 list_sort(list(lead_time_days) FILTER (lead_time_days IS NOT NULL))[count(lead_time_days) // 2 + 1] AS lead_median FROM inc""")
def _(spark, d):
    return B.summarize_incidents(incidents(spark, d))


FUNNEL = INCIDENTS + """, f AS (SELECT *, hash % 11 <> 0 AS on_chain, hash % 4 AS touched, hash % 3 AS named, hash % 7 <> 0 AS analyzable, hash % 5 <> 0 AS gradeable FROM
   (SELECT *, ('0x' || left(revert_sha, 6))::BIGINT AS hash FROM inc)),
 steps AS (SELECT *, CASE WHEN link_status = 'unlinked' THEN 'unlinked' WHEN link_status = 'unresolved' OR NOT on_chain THEN 'unresolved' WHEN is_nested THEN 'nested'
   WHEN touched = 0 AND named = 0 THEN 'irrelevant' WHEN NOT analyzable THEN 'outside_domain' WHEN NOT gradeable THEN 'ungradeable' ELSE 'pool' END AS step FROM f)"""


def funnel(spark, d):
    rows = incidents(spark, d).withColumn("hash", F.conv(F.left("revert_sha", F.lit(6)), 16, 10).cast("bigint")).selectExpr(
        "*", "hash % 11 <> 0 AS on_chain", "hash % 4 AS touched", "hash % 3 AS named", "hash % 7 <> 0 AS analyzable", "hash % 5 <> 0 AS gradeable")
    return B.funnel(rows)


@query("p20_incident_funnel", FUNNEL + " SELECT revert_sha, step FROM steps")
def _(spark, d):
    return funnel(spark, d).select("revert_sha", "step")


@query("t04_most_recent", FUNNEL + " SELECT revert_sha, revert_epoch FROM steps WHERE step = 'pool' ORDER BY revert_epoch DESC, revert_sha LIMIT 20")
def _(spark, d):
    return B.most_recent(funnel(spark, d).filter("step = 'pool'"), 20).select("revert_sha", "revert_epoch")


@query("a12_funnel_counts", FUNNEL + """ SELECT CAST(count(*) AS BIGINT) AS reverts_mined, CAST(count(*) FILTER (link_status <> 'unlinked') AS BIGINT) AS with_trailer, CAST(count(*) FILTER (step = 'unlinked') AS BIGINT) AS without_trailer,
 CAST(count(*) FILTER (step = 'unresolved') AS BIGINT) AS trailer_not_on_chain, CAST(count(*) FILTER (link_status <> 'unlinked') - count(*) FILTER (step = 'unresolved') AS BIGINT) AS linked_on_chain,
 CAST(count(*) FILTER (step = 'nested') AS BIGINT) AS nested_excluded, CAST(count(*) FILTER (is_nested) AS BIGINT) AS nested_total,
 CAST(count(*) FILTER (step IN ('irrelevant', 'outside_domain', 'ungradeable', 'pool')) AS BIGINT) AS eligible, CAST(count(*) FILTER (step = 'irrelevant') AS BIGINT) AS irrelevant,
 CAST(count(*) FILTER (step IN ('outside_domain', 'ungradeable', 'pool')) AS BIGINT) AS relevant, CAST(count(*) FILTER (step IN ('outside_domain', 'ungradeable', 'pool') AND touched > 0) AS BIGINT) AS relevant_by_path,
 CAST(count(*) FILTER (step = 'outside_domain') AS BIGINT) AS outside_domain, CAST(count(*) FILTER (step = 'ungradeable') AS BIGINT) AS ungradeable, CAST(count(*) FILTER (step = 'pool') AS BIGINT) AS pool,
 CAST(greatest(0, 100 - count(*) FILTER (step = 'pool')) AS BIGINT) AS shortfall FROM steps""")
def _(spark, d):
    return B.funnel_counts(funnel(spark, d), 100)


QUOTED = INCIDENTS + """, quoted AS (SELECT regexp_extract(revert_subject, '^Revert\\s+"(.+)"', 1) AS text FROM inc WHERE link_status = 'unlinked')"""


def quoted(inc):
    return inc.filter("link_status = 'unlinked'").select(F.regexp_extract("revert_subject", B.QUOTED_SUBJECT, 1).alias("text"))


@query("j29_quoted_subjects", QUOTED + """ SELECT DISTINCT s.sha FROM story s JOIN quoted q ON q.text = s.subject OR (q.text LIKE '%…' AND starts_with(s.subject, left(q.text, length(q.text) - 1)))""")
def _(spark, d):
    return B.quoted_matches(story(spark, d), quoted(incidents(spark, d)))


SCREEN = QUOTED + """, hit AS (SELECT DISTINCT s.sha FROM story s JOIN quoted q ON q.text = s.subject OR (q.text LIKE '%…' AND starts_with(s.subject, left(q.text, length(q.text) - 1)))),
 screened AS (SELECT s.sha, CASE WHEN n_parents <> 1 THEN 'merge' WHEN regexp_matches(subject, '(?i)\\brevert') THEN 'revert_itself' WHEN s.sha IN (SELECT reverted_sha FROM inc WHERE reverted_sha IS NOT NULL) THEN 'named_by_revert_trailer'
   WHEN s.sha IN (SELECT sha FROM hit) THEN 'quoted_by_unlinked_revert' WHEN s.k NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 40 IN (1, 2)) THEN 'not_touching_roots' ELSE 'pool' END AS screen FROM story s)"""


def screened(spark, d):
    s, inc = story(spark, d), incidents(spark, d)
    paths = view(spark, d, "changes").withColumnRenamed("sha", "k").join(s.select("k", "sha"), "k").select("sha", "path")
    reverted = inc.filter("reverted_sha is not null").select(F.col("reverted_sha").alias("sha"))
    return B.screen_controls(s, reverted, quoted(inc), paths, ["p/1/", "p/2/"])


@query("p21_control_screen", SCREEN + " SELECT sha, screen FROM screened")
def _(spark, d):
    return screened(spark, d)


@query("t03_hash_sample", SCREEN + """, ranked AS (SELECT sha, sha256(concat('salt:', sha)) AS rank_key, sha < 'c' AS usable FROM screened WHERE screen = 'pool'),
 took AS (SELECT rank_key FROM ranked WHERE usable ORDER BY rank_key LIMIT 20) SELECT * FROM ranked WHERE rank_key <= (SELECT max(rank_key) FROM took)""")
def _(spark, d):
    pool = screened(spark, d).filter("screen = 'pool'").select("sha")
    return B.hash_sample(pool, "salt", 20, F.col("sha") < "c").select("sha", "rank_key", "usable")


VOCAB = """ vocab AS (SELECT 'vendor' AS kind, n_name AS entity, n_name AS name FROM nation UNION ALL SELECT 'platform', concat('v/', s_suppkey), concat('arm64-', s_suppkey) FROM supplier
   UNION ALL SELECT 'family', concat('fam-', p_size), concat('fam-', p_size) FROM (SELECT DISTINCT p_size FROM part) UNION ALL VALUES ('family', 'vs', 'vs'), ('family', 'core switch', 'core switch'))"""
SUBJECTS = """SELECT o_orderkey AS id, concat(CASE o_orderkey % 3 WHEN 0 THEN concat('[NATION_', o_custkey % 30, ', vs] ') WHEN 1 THEN '[core switch/x] ' ELSE 'vs ' END, 'Fix arm64-', o_custkey % 200,
 CASE o_orderkey % 4 WHEN 0 THEN '-x' WHEN 1 THEN ': core switch' WHEN 2 THEN ' (Fam-7)' ELSE ' _nation_3 nation_4.' END) AS text FROM orders"""


def vocab(spark, d):
    return spark.sql(VOCAB.strip()[len("vocab AS ("):-1].replace("FROM nation", "FROM {nation}").replace("FROM supplier", "FROM {supplier}").replace("FROM part", "FROM {part}"),
                     nation=table(spark, d, "nation"), supplier=table(spark, d, "supplier"), part=table(spark, d, "part"))


def subjects(spark, d):
    return spark.sql(SUBJECTS.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


MENTION = r""" subj AS (""" + SUBJECTS + r"""), low AS (SELECT id, lower(text) AS t FROM subj), names AS (SELECT kind, entity, lower(name) AS name FROM vocab),
 tags AS (SELECT id, unnest(list_concat([trim(g)], string_split_regex(trim(g), '[^a-z0-9_.-]+'))) AS name FROM (SELECT id, unnest(regexp_extract_all(t, '\[([^\]]+)\]', 1)) AS g FROM low)),
 tagged AS (SELECT DISTINCT id, kind, entity FROM tags JOIN names USING (name) WHERE name <> ''),
 words AS (SELECT DISTINCT id, kind, entity FROM low JOIN names ON contains(t, name) WHERE name NOT IN ('delta', 'fs', 'nexthop', 'virtual', 'vs')
   AND regexp_matches(t, '(^|[^a-z0-9_-])' || regexp_escape(name) || '($|[^a-z0-9_-])')),
 mentioned AS (SELECT id, kind, entity, max(via) AS via FROM (SELECT *, 'subject_tag' AS via FROM tagged UNION ALL SELECT *, 'subject' FROM words) GROUP BY id, kind, entity)"""


@query("j21_mentions", "WITH" + VOCAB + "," + MENTION + " SELECT id, kind, entity, via FROM mentioned")
def _(spark, d):
    return B.mentions(subjects(spark, d), vocab(spark, d))


TRUTH_PATHS = """SELECT l_orderkey AS id, CASE l_partkey % 4 WHEN 0 THEN concat('device/v/', l_suppkey, '/x') WHEN 1 THEN concat('device/v/shared', l_suppkey % 5, '/y') WHEN 2 THEN concat('platform/fam-', l_partkey % 60, '/z') ELSE 'docs/a' END AS path FROM lineitem"""
TRUTH = MENTION + """, tp AS (SELECT DISTINCT id, path FROM (""" + TRUTH_PATHS + """)),
 ev AS (SELECT id, 'platform' AS kind, concat('v/', split_part(path, '/', 3)) AS entity, 'path' AS via, path, 0 AS o FROM tp WHERE starts_with(path, 'device/') AND NOT contains(path, 'shared')
  UNION ALL SELECT id, 'platform', concat('v/', s_suppkey), 'shared_path', path, 1 FROM tp JOIN supplier ON concat('shared', s_suppkey % 40) = split_part(path, '/', 3) WHERE starts_with(path, 'device/')
  UNION ALL SELECT id, 'family', split_part(path, '/', 2), 'family_path', path, 0 FROM tp WHERE starts_with(path, 'platform/') AND split_part(path, '/', 2) IN (SELECT entity FROM vocab WHERE kind = 'family')
  UNION ALL SELECT id, kind, entity, via, NULL, 2 FROM mentioned),
 truth AS (SELECT id, kind, entity, via, path AS detail FROM (SELECT *, row_number() OVER (PARTITION BY id, kind, entity ORDER BY path IS NULL, path, o, via) AS rn FROM ev) WHERE rn = 1)"""


def truth_inputs(spark, d):
    subj = subjects(spark, d).withColumnRenamed("text", "subject")
    paths = spark.sql(TRUTH_PATHS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, d, "lineitem"))
    shared = table(spark, d, "supplier").selectExpr("concat('device/v/shared', s_suppkey % 40) AS directory", "concat('v/', s_suppkey) AS entity")
    return subj, paths, vocab(spark, d), shared


def truth_parts(spark, d):
    """(direct, linked, shared): the truth without a row for each entity of a shared directory."""
    inputs = truth_inputs(spark, d)
    return *(checkpointed(part) for part in B.evidence(*inputs)), inputs[-1]


@query("j22_ground_truth", "WITH" + VOCAB + "," + TRUTH + " SELECT id, kind, entity, via, detail FROM truth")
def _(spark, d):
    return B.ground_truth(*truth_inputs(spark, d))


PLATS = """, plats AS (SELECT concat('v/', s_suppkey) AS platform, concat('NATION_', s_nationkey) AS vendor, concat('fam-', s_suppkey % 60) AS family,
  CASE s_suppkey % 3 WHEN 0 THEN 'covered' WHEN 1 THEN 'uncovered' ELSE 'ambiguous' END AS status FROM supplier)"""


def plats(spark, d):
    return table(spark, d, "supplier").selectExpr("concat('v/', s_suppkey) AS platform", "concat('NATION_', s_nationkey) AS vendor", "concat('fam-', s_suppkey % 60) AS family",
                                                  "CASE s_suppkey % 3 WHEN 0 THEN 'covered' WHEN 1 THEN 'uncovered' ELSE 'ambiguous' END AS status")


LANDING = PLATS + """, fine AS (SELECT DISTINCT id, platform FROM (SELECT id, entity AS platform FROM truth WHERE kind = 'platform' UNION ALL SELECT t.id, p.platform FROM truth t JOIN plats p ON t.kind = 'family' AND p.family = t.entity)
   WHERE platform IN (SELECT platform FROM plats)),
 landed AS (SELECT * FROM fine UNION SELECT t.id, p.platform FROM truth t JOIN plats p ON t.kind = 'vendor' AND p.vendor = t.entity WHERE t.id NOT IN (SELECT id FROM fine))"""


@query("a30_landing_rates", "WITH" + VOCAB + "," + TRUTH + LANDING + """ SELECT id, CAST(count(*) AS BIGINT) AS landed, CAST(count(*) FILTER (status = 'uncovered') AS BIGINT) AS landed_uncovered,
 CAST(count(*) FILTER (status = 'ambiguous') AS BIGINT) AS landed_ambiguous, bool_or(status <> 'covered') AS any_never_built, bool_or(status = 'uncovered') AS any_uncovered,
 round(count(*) FILTER (status <> 'covered') / CAST(count(*) AS DOUBLE), 6) AS share_never_built, round(count(*) FILTER (status = 'uncovered') / CAST(count(*) AS DOUBLE), 6) AS share_uncovered FROM landed JOIN plats USING (platform) GROUP BY id""")
def _(spark, d):
    p = plats(spark, d)
    return B.landing_rates_of(*truth_parts(spark, d), p.select("platform", "family"), p.select("platform", "vendor"), p.select("platform", "status"))


ITEM_CTES = PLATS + """, cov AS (SELECT DISTINCT l_orderkey AS id, platform, status FROM lineitem JOIN plats ON platform = concat('v/', l_suppkey) WHERE status <> 'covered'),
 hits AS (SELECT c.id, c.platform, t.entity, t.kind AS level FROM cov c JOIN plats p USING (platform) JOIN truth t ON t.id = c.id AND ((t.kind = 'platform' AND t.entity = c.platform) OR (t.kind = 'family' AND t.entity = p.family)
   OR (t.kind = 'vendor' AND t.entity = p.vendor AND t.id NOT IN (SELECT id FROM truth WHERE kind IN ('platform', 'family'))))),
 items AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'incident' ELSE 'control' END AS kind FROM orders),
 readings AS (SELECT * FROM (VALUES ('string_equality', true), ('architecture_aware', false)) r(reading, amb)),
 graded AS (SELECT i.id, i.kind, r.reading, count(DISTINCT c.platform) AS flagged, count(h.entity) > 0 AS recalled,
   CASE min(CASE h.level WHEN 'platform' THEN 0 WHEN 'family' THEN 1 WHEN 'vendor' THEN 2 END) WHEN 0 THEN 'platform' WHEN 1 THEN 'family' WHEN 2 THEN 'vendor' END AS level
   FROM items i CROSS JOIN readings r LEFT JOIN cov c ON c.id = i.id AND (r.amb OR c.status = 'uncovered') LEFT JOIN hits h ON h.id = c.id AND h.platform = c.platform GROUP BY i.id, i.kind, r.reading)"""


def coverage_of(spark, d):
    p = plats(spark, d)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("v/"), "l_suppkey").alias("platform")).join(
        p.select("platform", "status"), "platform").filter("status <> 'covered'").select("id", "platform", "status").distinct()


@query("j23_tiered_match", "WITH" + VOCAB + "," + TRUTH + ITEM_CTES + " SELECT DISTINCT id, platform, entity, level FROM hits")
def _(spark, d):
    p = plats(spark, d)
    direct, linked, shared = truth_parts(spark, d)
    return B.match(direct, coverage_of(spark, d), p.select("platform", "family"), p.select("platform", "vendor"), linked, shared)


def graded(spark, d):
    p = plats(spark, d)
    items = table(spark, d, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 2 = 0 THEN 'incident' ELSE 'control' END AS kind")
    direct, linked, shared = truth_parts(spark, d)
    return B.grade_items(items, coverage_of(spark, d), direct, p.select("platform", "family"), p.select("platform", "vendor"), linked, shared)


@query("j24_item_grading", "WITH" + VOCAB + "," + TRUTH + ITEM_CTES + " SELECT id, kind, reading, CAST(flagged AS BIGINT) AS flagged, recalled, level FROM graded")
def _(spark, d):
    return graded(spark, d)


def wil(k, n, p):
    return f"""CAST({k} AS BIGINT) AS {p}_k, CAST({n} AS BIGINT) AS {p}_n, round({k} / CAST({n} AS DOUBLE), 4) AS {p}_rate,
 round(greatest(0, (({k} / CAST({n} AS DOUBLE)) + 3.8416 / (2 * {n}) - 1.96 * sqrt(({k} / CAST({n} AS DOUBLE)) * (1 - {k} / CAST({n} AS DOUBLE)) / {n} + 3.8416 / (4 * {n} * {n}))) / (1 + 3.8416 / {n})), 4) AS {p}_low,
 round(least(1, (({k} / CAST({n} AS DOUBLE)) + 3.8416 / (2 * {n}) + 1.96 * sqrt(({k} / CAST({n} AS DOUBLE)) * (1 - {k} / CAST({n} AS DOUBLE)) / {n} + 3.8416 / (4 * {n} * {n}))) / (1 + 3.8416 / {n})), 4) AS {p}_high"""


@query("a13_backtest_rates", "WITH" + VOCAB + "," + TRUTH + ITEM_CTES + """, s AS (SELECT reading, CAST(count(*) FILTER (kind = 'incident' AND recalled) AS DOUBLE) AS r, CAST(count(*) FILTER (kind = 'incident') AS DOUBLE) AS i,
  CAST(count(*) FILTER (kind = 'control' AND flagged > 0) AS DOUBLE) AS c, CAST(count(*) FILTER (kind = 'control') AS DOUBLE) AS n, CAST(count(*) FILTER (flagged > 0) AS DOUBLE) AS p FROM graded GROUP BY reading)
 SELECT reading, """ + wil("r", "i", "recall") + "," + wil("c", "n", "control_flag") + "," + wil("r", "p", "precision") + " FROM s")
def _(spark, d):
    return B.backtest_rates(graded(spark, d))


@query("j33_submodule_names", """WITH g AS (SELECT DISTINCT l_orderkey AS sha, concat('m', l_partkey % 50) AS path FROM lineitem), m AS (SELECT o_orderkey AS sha, concat('m', o_custkey % 50) AS path, concat('name', o_custkey) AS name, concat('url', o_orderkey) AS url FROM orders)
 SELECT g.sha, g.path, coalesce(a.name, b.name, g.path) AS name, CASE WHEN a.sha IS NOT NULL THEN a.url ELSE b.url END AS url FROM g LEFT JOIN m a ON a.sha = g.sha AND a.path = g.path LEFT JOIN m b ON b.sha = g.sha - 1 AND b.path = g.path""")
def _(spark, d):
    links = table(spark, d, "lineitem").selectExpr("l_orderkey AS sha", "concat('m', l_partkey % 50) AS path").distinct()
    orders = table(spark, d, "orders")
    modules = orders.selectExpr("o_orderkey AS sha", "concat('m', o_custkey % 50) AS path", "concat('name', o_custkey) AS name", "concat('url', o_orderkey) AS url")
    return B.submodule_names(links, modules, orders.selectExpr("o_orderkey AS sha", "o_orderkey - 1 AS parent"))


@query("j31_aligned_records", "SELECT o_orderkey AS sha, o_totalprice, o_custkey FROM orders")
def _(spark, d):
    orders = table(spark, d, "orders")
    return B.align(orders.selectExpr("o_orderkey AS sha", "o_totalprice"), orders.selectExpr("o_orderkey AS sha", "o_custkey"))


ANSWERS = """SELECT o_orderkey AS id, concat('uses x86_64-box', o_custkey % 150, ', fam', o_custkey % 9, '-arm64. and arm64-', o_orderkey % 5, ' ok') AS text FROM orders"""


@query("j25_closed_world_check", f"""WITH a AS ({ANSWERS}), tok AS (SELECT DISTINCT id, lower(regexp_replace(unnest(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_.-]*')), '^[._-]+|[._-]+$', '', 'g')) AS token FROM a)
 SELECT id, token FROM tok WHERE NOT (id % 2 = 0 AND token = 'arm64-0') AND ((regexp_matches(token, '^(x86_64|arm64|armhf)-[a-z0-9]') AND token NOT IN (SELECT concat('x86_64-box', s_suppkey) FROM supplier))
   OR (regexp_full_match(token, 'fam[0-9]-arm64') AND split_part(token, '-', 1) IN (SELECT concat('fam', n_nationkey % 7) FROM nation) AND token NOT IN (SELECT concat('fam', n_nationkey % 7, '-arm64') FROM nation WHERE n_nationkey % 7 < 3)))""")
def _(spark, d):
    texts = spark.sql(ANSWERS.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))
    nation = table(spark, d, "nation")
    world = table(spark, d, "supplier").selectExpr("'platform' AS kind", "concat('v/x86_64-box', s_suppkey) AS name", "CAST(NULL AS STRING) AS family").union(
        nation.selectExpr("'asic_family'", "concat('fam', n_nationkey % 7)", "NULL")).union(
        nation.filter("n_nationkey % 7 < 3").selectExpr("'ci_job_group'", "concat('fam', n_nationkey % 7, '-arm64')", "concat('fam', n_nationkey % 7)"))
    shown = texts.filter("id % 2 = 0").selectExpr("id", "'see arm64-0.' AS text")
    return K.outside_names(texts, world, shown)


CITES = """SELECT conv_id * 1000 + turn AS id, conv_id AS c, turn AS t, text FROM conversations"""


@query("j26_citation_reread", f"""WITH c AS ({CITES}) SELECT id, CASE t % 4 WHEN 1 THEN 'out of range' WHEN 2 THEN 'does not read as quoted' END AS problem FROM c""")
def _(spark, d):
    c = spark.sql(CITES.replace("FROM conversations", "FROM {conversations}"), conversations=table(spark, d, "conversations"))
    lines = c.select(F.col("id").cast("string").alias("path"), F.lit("head").alias("rev"), F.posexplode(F.split("text", "\n")).alias("no", "text")).withColumn("no", (F.col("no") + 1).cast("bigint"))
    n = F.size(F.split("text", "\n")).cast("bigint")
    cites = c.select("id", F.col("id").cast("string").alias("path"), F.lit("head").alias("rev"), F.lit(1).cast("bigint").alias("line_start"),
                     F.when(F.col("t") % 4 == 1, n + 1).otherwise(n).alias("line_end"), F.when(F.col("t") % 4 == 2, F.concat(F.lit("x"), "text")).otherwise(F.concat("text", F.lit("  "))).alias("quote"))
    return K.reread(cites, lines)


@query("j27_cited_job_group", """WITH a AS (SELECT o_orderkey AS id, o_orderkey % 3 <> 0 AS covered, CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE concat('NATION_', o_custkey % 30) END AS g, concat('f', o_custkey % 4) AS f,
   CASE o_orderkey % 2 WHEN 0 THEN 'amd64' ELSE 'arm64' END AS arch, CASE o_orderkey % 7 WHEN 0 THEN 'undetermined' WHEN 1 THEN 'covered' ELSE 'uncovered' END AS rule FROM orders),
 r AS (SELECT a.*, n_name, CASE WHEN n_name IS NULL THEN NULL WHEN concat('f', n_nationkey % 4) <> f AND CASE n_nationkey % 2 WHEN 0 THEN 'amd64' ELSE 'arm64' END <> arch THEN 'other family and other architecture'
    WHEN concat('f', n_nationkey % 4) <> f THEN 'other family' WHEN CASE n_nationkey % 2 WHEN 0 THEN 'amd64' ELSE 'arm64' END <> arch THEN 'other architecture' END AS wrong FROM a LEFT JOIN nation ON n_name = g),
 p AS (SELECT *, CASE WHEN covered THEN CASE WHEN g IS NULL THEN 'no job group' WHEN n_name IS NULL THEN 'unknown job group' ELSE wrong END END AS problem FROM r)
 SELECT id, problem, CASE WHEN problem IS NOT NULL THEN 'dropped' WHEN rule = 'undetermined' THEN 'unconfirmed' WHEN covered = (rule = 'covered') THEN 'confirmed' ELSE 'contested' END AS outcome FROM p""")
def _(spark, d):
    answers = table(spark, d, "orders").selectExpr(
        "o_orderkey AS id", "o_orderkey % 3 <> 0 AS covered", "CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE concat('NATION_', o_custkey % 30) END AS job_group", "array(concat('f', o_custkey % 4)) AS families",
        "CASE o_orderkey % 2 WHEN 0 THEN 'amd64' ELSE 'arm64' END AS arch", "CASE o_orderkey % 7 WHEN 0 THEN 'undetermined' WHEN 1 THEN 'covered' ELSE 'uncovered' END AS rule_resolution")
    groups = table(spark, d, "nation").selectExpr("n_name AS name", "concat('f', n_nationkey % 4) AS family", "CASE n_nationkey % 2 WHEN 0 THEN 'amd64' ELSE 'arm64' END AS arch")
    return K.cited_groups(answers, groups)


@query("f23_confidence_band", """WITH a AS (SELECT l_orderkey AS q, CASE l_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS c, l_linenumber AS n FROM lineitem),
 s AS (SELECT q, max(c) AS best, count(*) FILTER (c = 1) AS complete, coalesce(sum(n) FILTER (c = 1), 0) AS breadth FROM a GROUP BY q),
 o AS (SELECT o_orderkey AS question, CASE o_orderkey % 4 WHEN 0 THEN 0.4 ELSE 0.7 END::DOUBLE AS prior, o_orderkey % 5 = 0 AS contested, o_orderkey % 7 = 0 AS undecided, s.* FROM orders LEFT JOIN s ON q = o_orderkey)
 SELECT question, CASE WHEN best IS NULL THEN NULL WHEN complete = 0 OR prior < 0.5 OR undecided THEN 'low' WHEN contested THEN 'medium' WHEN breadth >= 3 THEN 'high' ELSE 'medium' END AS band,
  round(prior * best * CASE WHEN breadth <= 0 THEN 0.5::DOUBLE ELSE 0.5::DOUBLE + 0.5::DOUBLE * least(1.0::DOUBLE, log2(1 + breadth) / log2(17)) END * CASE WHEN contested THEN 0.8::DOUBLE ELSE 1 END, 3) AS score,
  round(coalesce(best, 0), 3) AS completeness, CAST(coalesce(breadth, 0) AS BIGINT) AS breadth FROM o""")
def _(spark, d):
    questions = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("question"), F.expr("CASE o_orderkey % 4 WHEN 0 THEN 0.4D ELSE 0.7D END").alias("prior"), F.array(F.lit("cause"), F.lit("affected")).alias("required"),
        F.expr("o_orderkey % 5 = 0").alias("contested"), F.expr("o_orderkey % 7 = 0").alias("undecided"))
    roles = F.expr("CASE l_partkey % 3 WHEN 0 THEN array('cause', 'affected', 'x') WHEN 1 THEN array('cause') ELSE array('x') END")
    answers = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question"), roles.alias("roles"), F.col("l_linenumber").alias("platforms"))
    return K.band_questions(questions, answers)


FINDINGS = """SELECT o_custkey AS report, o_orderkey AS question, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity,
 CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'low' WHEN 2 THEN 'high' ELSE 'medium' END AS band, o_orderkey % 11 AS never_built FROM orders"""


@query("t06_finding_posting", f"""WITH RECURSIVE f AS ({FINDINGS}), r AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC,
   CASE band WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, never_built DESC, question) AS position FROM f),
 walk(report, position, question, band, posted, n) AS (SELECT report, position, question, band, coalesce(band IN ('high', 'medium'), false), CASE WHEN band IN ('high', 'medium') THEN 1 ELSE 0 END FROM r WHERE position = 1
  UNION ALL SELECT r.report, r.position, r.question, r.band, r.position <= 10 AND coalesce(r.band = 'high' OR (r.band = 'medium' AND w.n < 5), false),
   w.n + CASE WHEN r.position <= 10 AND (r.band = 'high' OR (r.band = 'medium' AND w.n < 5)) THEN 1 ELSE 0 END FROM walk w JOIN r ON r.report = w.report AND r.position = w.position + 1)
 SELECT report, question, position, posted, CASE WHEN position > 10 THEN 'beyond the cap' WHEN NOT posted AND band IS NOT NULL THEN 'below the threshold' END AS suppressed FROM walk""")
def _(spark, d):
    return K.rank_findings(spark.sql(FINDINGS.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders")))


@query("t08_evidence_pick", """WITH i AS (SELECT l_orderkey AS finding, l_partkey AS number, l_returnflag AS role, l_tax > 0.04 AS cited FROM lineitem),
 c AS (SELECT finding, number FROM i WHERE cited UNION SELECT finding, min(number) FROM i GROUP BY finding, role)
 SELECT * FROM (SELECT finding, number, row_number() OVER (PARTITION BY finding ORDER BY number) AS n FROM c) WHERE n <= 8""")
def _(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("finding"), F.col("l_partkey").alias("number"), F.col("l_returnflag").alias("role"), F.expr("l_tax > 0.04").alias("cited"))
    return K.pick_evidence(items, K.MAX_EVIDENCE).drop("chosen")


@query("t08_evidence_pick_whole", """WITH i AS (SELECT l_orderkey AS finding, l_partkey AS number, l_returnflag AS role, l_tax > 0.04 AS cited FROM lineitem),
 c AS (SELECT finding, number FROM i WHERE cited UNION SELECT finding, min(number) FROM i GROUP BY finding, role)
 SELECT finding, number, row_number() OVER (PARTITION BY finding ORDER BY number) AS n, count(*) OVER (PARTITION BY finding) AS chosen FROM c""")
def _(spark, d):
    return K.pick_evidence(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("finding"), F.col("l_partkey").alias("number"), F.col("l_returnflag").alias("role"), F.expr("l_tax > 0.04").alias("cited")))


@query("a37_verdicts", """SELECT l_orderkey AS question, CASE WHEN bool_or(l_returnflag = 'R') THEN 'material' WHEN bool_and(l_returnflag = 'N') THEN 'pass_through' ELSE 'unclear' END AS resolution
 FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey""")
def _(spark, d):
    verdict = F.expr("CASE WHEN l_linestatus <> 'O' THEN '' WHEN l_returnflag = 'R' THEN 'material' WHEN l_returnflag = 'N' THEN 'pass_through' ELSE 'unclear' END")
    return K.roll_up_verdicts(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question"), verdict.alias("verdict")))


@query("q02_report_contracts", """WITH o AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS band, o_orderkey % 2 = 0 AS posted, o_custkey FROM orders)
 SELECT 'unbound question' AS rule, k AS finding FROM o WHERE o_custkey % 50 = 0 UNION ALL SELECT 'contested above medium', k FROM o WHERE band = 'high' AND k IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
 UNION ALL SELECT 'posts a low band', k FROM o WHERE posted AND band = 'low' UNION ALL SELECT DISTINCT 'drops without a check', l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1
 UNION ALL SELECT 'numbers differ', k FROM o WHERE k % 10 = 0 UNION ALL SELECT DISTINCT 'outside the closed world', l_orderkey FROM lineitem WHERE l_suppkey % 20 = 0""")
def _(spark, d):
    orders, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    findings = orders.selectExpr("o_orderkey AS finding", "o_custkey AS question", "CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS band", "o_orderkey % 2 = 0 AS posted",
                                 "1 AS affected", "CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS brief_affected")
    answers = li.selectExpr("l_orderkey AS finding", "CASE l_returnflag WHEN 'R' THEN 'contested' WHEN 'A' THEN 'dropped' ELSE 'confirmed' END AS outcome", "CASE WHEN l_linenumber = 1 THEN '' ELSE 'citation' END AS check", "'A' AS grp")
    questions = table(spark, d, "customer").filter("c_custkey % 50 <> 0").selectExpr("c_custkey AS question")
    named = li.selectExpr("l_orderkey AS finding", "l_suppkey AS id")
    world = table(spark, d, "supplier").filter("s_suppkey % 20 <> 0").selectExpr("s_suppkey AS id")
    return K.report_problems(findings, answers, questions, named, world)


@query("q03_no_lookahead", cte("facts") + " SELECT idx, " + ", ".join(f"0 AS {name}" for name in W.HISTORY) + " FROM facts WHERE false")
def _(spark, d):
    def compute(f):
        wide = f.select("sha", "idx")
        for family in history_families(spark, d, f):
            wide = wide.join(family.select("sha", *[name for name in W.HISTORY if name in family.columns]), "sha")
        return wide.select("idx", *W.HISTORY)

    f = facts(spark, d)
    return K.lookahead_problems(compute, f, f.count() // 2)


@query("q03_lookahead_caught", cte("commits") + """ SELECT CAST(count(*) AS BIGINT) AS changed FROM (SELECT author_id FROM commits WHERE idx <= (SELECT count(*) // 2 FROM commits) AND author_id IN (SELECT author_id FROM commits WHERE idx > (SELECT count(*) // 2 FROM commits)))""")
def _(spark, d):
    def leaking(f):
        totals = f.groupBy("author_id").agg(F.count(F.lit(1)).alias("n"))
        return f.select("idx", "author_id").join(totals, "author_id")

    c = commits(spark, d)
    problems = K.lookahead_problems(leaking, c, c.count() // 2)
    return problems.agg(F.floor(F.count(F.lit(1)) / 2).alias("changed"))


@query("f20_log_share_transforms", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(ln(1 + greatest(coalesce(q, 0), 0)), 6) AS log_q, CASE WHEN q IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS q_missing,
 CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END::DOUBLE AS flag_a FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity - 10 END AS q FROM lineitem)""")
def _(spark, d):
    q = F.expr("CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity - 10 END")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(log_count(q), 6).alias("log_q"), missing(q).alias("q_missing"),
                                              (F.col("l_returnflag") == "A").cast("double").alias("flag_a"))


@query("f21_logit_platt", """SELECT event_id, round(ln(p / (1 - p)), 6) AS logit, round(1 / (1 + exp(-(ln(p / (1 - p)) * CAST(1.5 AS DOUBLE) - CAST(0.25 AS DOUBLE)))), 6) AS calibrated FROM (SELECT event_id, least(greatest(value / 400, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p FROM events)""")
def _(spark, d):
    p = F.col("value") / 400
    return table(spark, d, "events").select("event_id", F.round(logit(p), 6).alias("logit"), F.round(platt(p, 1.5, -0.25), 6).alias("calibrated"))


@query("f24_content_hash", """SELECT c_custkey, sha256(concat('{"acctbal":"', c_acctbal, '","key":', c_custkey, ',"name":"', c_name, '"}')) AS sha FROM (SELECT c_custkey, c_name, CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) AS c_acctbal FROM customer)""")
def _(spark, d):
    from ..sources.manifest import content_hash

    rows = table(spark, d, "customer").selectExpr("c_custkey", "c_name AS name", "c_custkey AS key", "CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS STRING) AS acctbal")
    return rows.select("c_custkey", content_hash(["name", "key", "acctbal"]).alias("sha"))


@query("m10_unseen_commit_features", cte("facts") + """ SELECT c_custkey AS author_id, CAST((SELECT count(*) FROM facts f WHERE f.author_id = c_custkey) AS BIGINT) AS author_prior_commits FROM customer""")
def _(spark, d):
    from ..operators.models import unseen_rows

    f = facts(spark, d)
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("author_id"), (-F.col("c_custkey") - 1).alias("sha"), F.lit(0).cast("bigint").alias("committed_epoch"))
    return unseen_rows(f, new, lambda rows: H.author_prior(rows)).select("author_id", "author_prior_commits")


@query("s14_dataset_card", cte("facts") + "," + SPLIT_CTES + """ SELECT CAST(count(*) AS BIGINT) AS commits, CAST(count(*) FILTER (is_merge) AS BIGINT) AS merges, CAST(count(*) FILTER (is_revert) AS BIGINT) AS reverts, min(landed) AS first_landed, max(landed) AS last_landed,
 CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS file_paths, CAST(count(*) FILTER (split = 'train') AS BIGINT) AS train, CAST(count(*) FILTER (split = 'gap') AS BIGINT) AS gap,
 CAST(count(*) FILTER (fix_like) AS BIGINT) AS fixes FROM splits""")
def _(spark, d):
    from ..operators.splits import assign_splits
    from ..sources.dataset import dataset_card

    f = facts(spark, d)
    kinds = f.select("sha", F.when(F.col("fix_like"), "fix").otherwise("chore").alias("change_type"))
    card = dataset_card(f, view(spark, d, "changes"), assign_splits(f)[0].select("sha", "split"), kinds=kinds)
    return card.select("commits", "merges", "reverts", "first_landed", "last_landed", "file_paths", F.col("splits")["train"].alias("train"),
                       F.col("splits")["gap"].alias("gap"), F.col("categories")["fix"].alias("fixes"))


@query("w02_running_maximum_blocks", cte("facts") + " SELECT sha, landed FROM facts")
def _(spark, d):
    return running(commits(spark, d), [], "idx", maxes={"landed": F.col("committed_epoch")}, inclusive=True, width=500).select("sha", "landed")
