"""Registered queries: sources, sinks, text exports, lineages and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import documents as W
from ..operators import history as H
from ..operators import lineage as N
from ..sources import dataset as S
from ..sources import history_text as X
from ..sources import trees
from ..session import checkpoint_dir, checkpointed
from .registering import Collector
from .history import HISTORY_TAIL
from .review import INCIDENTS, incidents
from .views import cte, facts, table, view

query = Collector()
QUERIES, ORACLES = query.queries, query.oracles


def folder(spark):
    """A new path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"


@query("s02_json_parts_round_trip", cte("facts") + " SELECT idx, sha, landed, is_merge FROM facts")
def _(spark, d):
    path = folder(spark)
    S.write_json_parts(facts(spark, d).select("idx", "sha", "landed", "is_merge"), path)
    return S.read_json_parts(spark, path, "idx bigint, sha bigint, landed bigint, is_merge boolean")


RECORDS = """SELECT named_struct('sha', sha2(CAST(doc_id AS STRING), 256), 'committed_at', '2024-01-01T00:00:00Z', 'is_merge', doc_id % 41 = 0) AS commit,
 named_struct('subject', left(text, 50), 'body', text, 'subject_tags', CASE WHEN doc_id % 3 = 0 THEN array('ci') ELSE CAST(array() AS ARRAY<STRING>) END, 'pr_number', CASE WHEN doc_id % 4 = 0 THEN doc_id END,
  'sections', CASE WHEN doc_id % 5 = 0 THEN map('why', left(text, 2000)) ELSE CAST(map() AS MAP<STRING, STRING>) END,
  'revert', named_struct('is_revert', doc_id % 7 = 0, 'reverts_sha', CASE WHEN doc_id % 14 = 0 THEN 'abcdef0123456789' END, 'reverts_pr', CASE WHEN doc_id % 21 = 0 THEN doc_id END)) AS message,
 array(named_struct('status', 'M', 'old_path', 'a/x.py', 'new_path', 'a/x.py', 'file_class', 'code', 'binary', false, 'additions', 3, 'deletions', 1, 'patch', concat('+', text), 'patch_truncated', false, 'scopes', array('f', 'g', 'h', 'i')),
  named_struct('status', 'R', 'old_path', 'b/old', 'new_path', 'b/new', 'file_class', 'other', 'binary', true, 'additions', CAST(NULL AS INT), 'deletions', CAST(NULL AS INT), 'patch', CAST(NULL AS STRING), 'patch_truncated', doc_id % 9 = 0, 'scopes', CAST(array() AS ARRAY<STRING>))) AS files,
 CAST(array() AS ARRAY<STRUCT<path: STRING, name: STRING, url: STRING, old_sha: STRING, new_sha: STRING>>) AS submodules,
 named_struct('components', array(named_struct('id', source, 'path_count', 1)), 'features', CAST(array() AS ARRAY<STRUCT<id: STRING, path_count: INT>>),
  'entities', transform(sequence(1, CAST(doc_id % 25 AS INT) + 1), i -> named_struct('id', concat('e', i), 'kind', 'vendor', 'name', 'e', 'path_count', 1)), 'unmapped_paths', CAST(array() AS ARRAY<STRING>)) AS areas, doc_id AS idx FROM {documents}"""


def records(spark, d):
    return spark.sql(RECORDS, documents=table(spark, d, "documents"))


@query("s01_record_source", """SELECT doc_id AS idx, sha256(CAST(doc_id AS VARCHAR)) AS sha, md5(text) AS body, 2::BIGINT AS n_files FROM documents""")
def _(spark, d):
    path = folder(spark)
    S.write_json_parts(records(spark, d), path, rows=100)
    back = S.read_records(spark, path)
    return back.select("idx", F.col("commit.sha").alias("sha"), F.md5("message.body").alias("body"), F.size("files").cast("bigint").alias("n_files"))


@query("s03_s04_feature_table_round_trip", cte("facts") + " SELECT sha, idx, landed FROM facts WHERE NOT is_merge")
def _(spark, d):
    path = folder(spark)
    S.write_features(facts(spark, d), path)
    return S.read_features(spark, path).filter("not is_merge").select("sha", "idx", "landed")


@query("s05_numstat", """SELECT l_orderkey AS sha, l_linenumber AS n, CASE WHEN l_partkey % 7 = 0 THEN concat('new/', l_partkey) ELSE concat('p/', l_partkey) END AS path,
 CASE WHEN l_partkey % 11 <> 0 THEN CAST(l_quantity AS BIGINT) END AS additions, CASE WHEN l_partkey % 11 <> 0 THEN CAST(round(l_discount * 100) AS BIGINT) END AS deletions, l_partkey % 11 = 0 AS binary FROM lineitem""")
def _(spark, d):
    line = F.expr("""concat(CASE WHEN l_partkey % 11 = 0 THEN '-' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END, chr(9), CASE WHEN l_partkey % 11 = 0 THEN '-' ELSE CAST(CAST(round(l_discount * 100) AS BIGINT) AS STRING) END, chr(9),
        CASE WHEN l_partkey % 7 = 0 THEN concat('{old/x => new/', l_partkey, '}') ELSE concat('p/', l_partkey) END)""")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_linenumber").alias("n"), line.alias("value"))
    return X.numstat(lines)


@query("s06_raw_and_counts", """SELECT DISTINCT l_orderkey AS sha, CASE l_partkey % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'A' WHEN 2 THEN 'D' ELSE 'M' END AS status, CASE WHEN l_partkey % 4 <> 1 THEN concat('o/', l_partkey) END AS old_path,
 CASE l_partkey % 4 WHEN 0 THEN concat('n/', l_partkey) WHEN 2 THEN NULL ELSE concat('o/', l_partkey) END AS new_path, CASE WHEN l_partkey % 4 <> 1 THEN '100644' END AS old_mode, l_partkey * 2 AS additions FROM lineitem""")
def _(spark, d):
    base = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    raw = base.selectExpr("l_orderkey AS sha", "CASE l_partkey % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'A' WHEN 2 THEN 'D' ELSE 'M' END AS status", "CASE WHEN l_partkey % 4 <> 1 THEN concat('o/', l_partkey) END AS old_path",
                          "CASE l_partkey % 4 WHEN 0 THEN concat('n/', l_partkey) WHEN 2 THEN NULL ELSE concat('o/', l_partkey) END AS new_path", "CASE WHEN l_partkey % 4 = 1 THEN '000000' ELSE '100644' END AS old_mode",
                          "'100644' AS new_mode", "'a' AS old_blob", "'b' AS new_blob")
    counts = base.selectExpr("l_orderkey AS sha", "CASE WHEN l_partkey % 4 = 0 THEN concat('o/', l_partkey) END AS old_path", "CASE WHEN l_partkey % 4 = 0 THEN concat('n/', l_partkey) ELSE concat('o/', l_partkey) END AS new_path",
                             "l_partkey * 2 AS additions", "0 AS deletions", "false AS binary")
    return X.join_counts(raw, counts).select("sha", "status", "old_path", "new_path", "old_mode", "additions")


@query("s07_tree_listing", r"""SELECT '100644' AS mode, 'blob' AS kind, left(sha256(url), 40) AS sha, path FROM (SELECT url, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)""")
def _(spark, d):
    lines = view(spark, d, "page_paths").select(F.concat(F.lit("100644 blob "), F.left(F.sha2("url", 256), F.lit(40)), F.lit("\t"), "path").alias("value"))
    return trees.tree_listing(lines.union(lines.limit(1).select(F.lit("not a listing line"))))


@query("s07_directories", cte("page_paths") + r""" SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM page_paths WHERE regexp_matches(path, '/en/')""")
def _(spark, d):
    return trees.directories_containing(view(spark, d, "page_paths"), "/en/")


@query("s07_path_count", cte("page_paths") + """ SELECT CAST(count(*) AS BIGINT) AS n FROM page_paths""")
def _(spark, d):
    return trees.path_count(view(spark, d, "page_paths"))


@query("s10_change_sets_round_trip", """SELECT CAST(conv_id AS VARCHAR) AS change_id, CAST(turn AS BIGINT) AS file_no, CAST(count(*) AS BIGINT) AS n_lines, md5(string_agg(line, chr(10) ORDER BY i)) AS content FROM
 (SELECT conv_id, turn, i, l[i] AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations), unnest(range(1, len(l) + 1)) AS u(i)) GROUP BY conv_id, turn""")
def _(spark, d):
    from pyspark.sql import types as T

    lines = F.transform(F.split("text", "\n"), lambda text, at: F.struct(F.lit("added").alias("kind"), text.alias("content"), F.lit(None).cast("int").alias("old_lineno"), (at + 1).alias("new_lineno")))
    hunk = F.struct(F.lit(0).alias("old_start"), F.lit(0).alias("old_count"), F.lit(1).alias("new_start"), F.size("lines").alias("new_count"), F.col("lines"))
    file = F.struct(F.concat(F.lit("f"), "turn").alias("path"), F.lit(None).cast("string").alias("old_path"), F.lit("added").alias("change_type"), F.lit(False).alias("is_binary"), F.array(hunk).alias("hunks"))
    nested = table(spark, d, "conversations").withColumn("lines", lines).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", file.alias("file")))).alias("fs")).select(
        F.col("conv_id").cast("string").alias("change_id"), F.array(F.struct(F.lit("s").alias("sha"), F.transform("fs", lambda item: item["file"]).alias("files"))).alias("commits"))
    path = folder(spark)
    S.write_change_sets(nested, path)
    back = S.read_change_sets(spark, path)
    assert isinstance(back.schema, T.StructType)
    _files, _hunks, rows = S.flatten_change_sets(back)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "content"))), lambda x: x["content"]), "\n")
    return rows.groupBy("change_id", F.col("file_no").cast("bigint").alias("file_no")).agg(F.count(F.lit(1)).alias("n_lines"), F.md5(text).alias("content"))


@query("s11_incidents_round_trip", INCIDENTS + " SELECT revert_sha, link_status, reverted_sha, lead_time_days, 0::BIGINT AS n_paths FROM inc")
def _(spark, d):
    path = folder(spark)
    rows = incidents(spark, d)
    S.write_incidents(rows.withColumn("unknown_key", F.lit(1)), path)
    back = S.read_incidents(spark, path)
    return back.select("revert_sha", "link_status", "reverted_sha", "lead_time_days", F.size("revert_paths").cast("bigint").alias("n_paths"))


@query("s12_exclusions", """SELECT lower(concat('ABC', c_custkey)) AS prefix FROM customer WHERE c_custkey % 3 <> 0""")
def _(spark, d):
    line = F.expr("CASE c_custkey % 3 WHEN 0 THEN '  # only a comment' WHEN 1 THEN concat('  ABC', c_custkey, ' # why') ELSE concat('ABC', c_custkey) END")
    return S.read_exclusions(table(spark, d, "customer").select(line.alias("value")))


@query("s13_corpus_round_trip", INCIDENTS + " SELECT revert_sha, link_status FROM inc WHERE link_status = 'linked'")
def _(spark, d):
    path = folder(spark)
    rows = checkpointed(incidents(spark, d).select("revert_sha", "link_status"))
    kept = rows.filter("link_status = 'linked'")
    S.write_corpus({"incidents": kept, "controls": rows.limit(0), "candidates": rows, "manifest": kept.groupBy().agg(F.count(F.lit(1)).alias("items"))}, path, "1")
    return S.read_corpus(spark, path, "1")["incidents"]


MARKED = """SELECT doc_id AS path, concat(text, chr(10), '@pytest.mark.topology("t', doc_id % 5, ', any")', chr(10), '@pytest.mark.skip("x")', chr(10), CASE WHEN doc_id % 3 = 0 THEN 'pytest.mark.topologies' ELSE '' END,
 chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('FROM base-', doc_id % 4, ':1', chr(10), '  from two', chr(10), 'RUN apt-get update && apt install', chr(10), '{% include "m', doc_id % 3, '.j2" %}') ELSE '' END) AS text FROM documents"""


def marked(spark, d):
    return spark.sql(MARKED.replace("FROM documents", "FROM {documents}").replace("{% include", "{{% include").replace("%}'", "%}}'"), documents=table(spark, d, "documents"))


@query("a32_topology_marks", """SELECT topology, CAST(count(*) AS BIGINT) AS files FROM (SELECT doc_id, unnest([concat('t', doc_id % 5, ', any'), concat('t', doc_id % 5), 'any', CASE WHEN doc_id % 3 = 0 THEN 'topologies' END]) AS topology FROM documents)
 WHERE topology IS NOT NULL GROUP BY topology""")
def _(spark, d):
    return X.topology_counts(X.topology_marks(marked(spark, d)))


@query("a33_image_files", "WITH m AS (" + MARKED + r"""), r AS (SELECT path, regexp_extract_all(text, '(?im)^\s*FROM\s+(\S+)', 1) AS b, regexp_extract_all(text, '\{%\s*include\s+[''"]([^''"]+)[''"]', 1) AS i,
 len(regexp_extract_all(text, '\bapt-get\b|\bapt\b')) AS n FROM m)
 SELECT path, array_to_string(b[:12], ',') AS bases, array_to_string(i[:20], ',') AS includes, CAST(n AS BIGINT) AS apt_mentions FROM r WHERE len(b) > 0 OR len(i) > 0 OR n > 0""")
def _(spark, d):
    return X.image_files(marked(spark, d), X.FROM_KEPT, X.INCLUDES_KEPT).select("path", F.array_join("bases", ",").alias("bases"), F.array_join("includes", ",").alias("includes"), F.col("apt_mentions").cast("bigint").alias("apt_mentions"))


@query("a33_image_files_whole", ORACLES["a33_image_files"].replace("b[:12]", "b").replace("i[:20]", "i"))
def _(spark, d):
    return X.image_files(marked(spark, d)).select("path", F.array_join("bases", ",").alias("bases"), F.array_join("includes", ",").alias("includes"), F.col("apt_mentions").cast("bigint").alias("apt_mentions"))


@query("f18_documents")
def _(spark, d):
    done = W.documents(records(spark, d))
    return done.select("sha", "chars", "diff_complete", F.md5("text").alias("text_md5"))


@query("f17_commit_text", r"""SELECT sha256(CAST(doc_id AS VARCHAR)) AS sha, md5(concat_ws(chr(10), left(text, 50), CASE WHEN doc_id % 5 = 0 AND text <> '' THEN left(text, 2000) ELSE left(text, 3000) END,
 'py', 'old', 'new')) AS text_md5 FROM documents""")
def _(spark, d):
    return W.commit_text(records(spark, d)).select("sha", F.md5("text").alias("text_md5"))


@query("f17_commit_items", """SELECT sha256(CAST(doc_id AS VARCHAR)) AS sha, unnest(list_concat(['file:a/x.py', 'file:b/old', 'file:b/new', concat('component:', source)],
 list_transform(range(1, doc_id % 25 + 2), lambda i: concat('entity:e', i)))) AS item FROM documents""")
def _(spark, d):
    return W.commit_items(records(spark, d))


def renames(spark, d):
    """Changes with renames and deletes: a part's path moves on at some touches and ends at others."""
    f = facts(spark, d).select("sha", "idx")
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey AS sha", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").join(f, "sha").groupBy("idx", "l_partkey").agg(F.min("l_suppkey").alias("k"))
    status = F.expr("CASE WHEN k % 10 = 0 THEN 'R' WHEN k % 10 = 1 THEN 'D' WHEN k % 10 = 2 THEN 'A' ELSE 'M' END")
    path = F.concat(F.lit("p/"), F.floor(F.col("l_partkey") / 3), F.lit("/"), F.col("l_partkey") % 3)
    other = F.concat(F.lit("p/"), F.floor(F.col("l_partkey") / 3), F.lit("/"), (F.col("l_partkey") + 1) % 3)
    return rows.select("idx", F.col("l_partkey").alias("seq"), status.alias("status"), F.when(status != "A", path).alias("old_path"),
                       F.when(status == "R", other).when(status != "D", path).alias("new_path"))


LINEAGE_CTES = """,
 per AS (SELECT f.idx, l_partkey AS seq, min(l_suppkey) % 10 AS k, concat('p/', l_partkey // 3, '/', l_partkey % 3) AS path,
   concat('p/', l_partkey // 3, '/', (l_partkey + 1) % 3) AS other FROM lineitem JOIN facts f ON f.sha = l_orderkey GROUP BY f.idx, l_partkey),
 ch AS (SELECT idx, row_number() OVER (ORDER BY idx, seq) - 1 AS pos, CASE k WHEN 0 THEN 'R' WHEN 1 THEN 'D' WHEN 2 THEN 'A' ELSE 'M' END AS status,
   CASE WHEN k <> 2 THEN path END AS old_path, CASE k WHEN 0 THEN other WHEN 1 THEN NULL ELSE path END AS new_path FROM per),
 ev0 AS (SELECT idx, pos, old_path AS path, 1 AS ends, 'parent' AS role FROM ch WHERE status = 'R' UNION ALL SELECT idx, pos, new_path, 1, 'child' FROM ch WHERE status = 'R'
   UNION ALL SELECT idx, pos, old_path, 1, 'touch' FROM ch WHERE status = 'D' UNION ALL SELECT idx, pos, coalesce(new_path, old_path), 0, 'touch' FROM ch WHERE status NOT IN ('R', 'D')),
 asked AS (SELECT idx, min(pos) OVER (PARTITION BY idx) AS pos, old_path AS path, status FROM ch),
 marks AS (SELECT path, pos, sum(ends) AS ends FROM (SELECT path, pos, ends FROM ev0 UNION ALL SELECT path, pos, 0 FROM asked WHERE status <> 'A') GROUP BY path, pos),
 lives AS (SELECT path, pos, coalesce(sum(ends) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM marks),
 placed AS (SELECT e.idx, e.pos, e.role, concat(e.path, chr(0), CAST(v.life + CASE e.role WHEN 'child' THEN 1 ELSE 0 END AS BIGINT)) AS node FROM ev0 e JOIN lives v ON v.path = e.path AND v.pos = e.pos),
 ups AS (SELECT a.node, b.node AS up FROM placed a JOIN placed b ON a.pos = b.pos AND a.role = 'child' AND b.role = 'parent'),
 climb(node, up) AS (SELECT node, up FROM ups UNION ALL SELECT c.node, u.up FROM climb c JOIN ups u ON u.node = c.up),
 roots AS (SELECT node, up FROM climb WHERE up NOT IN (SELECT node FROM ups)),
 touched AS (SELECT p.idx, coalesce(r.up, p.node) AS lineage FROM placed p LEFT JOIN roots r ON r.node = p.node WHERE p.role <> 'parent')"""


@query("w06_lineages", cte("facts").replace("WITH", "WITH RECURSIVE", 1) + LINEAGE_CTES + """
 SELECT lineage, count(*) AS touches, min(idx) AS first, max(idx) AS last FROM touched GROUP BY lineage""")
def _(spark, d):
    touches, _ = N.lineages(renames(spark, d), reading=False)
    return touches.groupBy("lineage").agg(F.count(F.lit(1)).alias("touches"), F.min("idx").alias("first"), F.max("idx").alias("last"))


@query("w07_file_history_with_renames", cte("facts").replace("WITH", "WITH RECURSIVE", 1) + LINEAGE_CTES + """,
 ev AS (SELECT t.idx, t.lineage AS path, f.author_id, f.fix_like, f.landed FROM touched t JOIN facts f USING (idx)),
 sizes AS (SELECT idx, count(*) AS n FROM ch GROUP BY idx),
 reads AS (SELECT DISTINCT n.idx, coalesce(r.up, n.node) AS path FROM (SELECT a.idx, concat(a.path, chr(0), CAST(v.life AS BIGINT)) AS node
   FROM asked a JOIN lives v ON v.path = a.path AND v.pos = a.pos WHERE a.status <> 'A') n LEFT JOIN roots r ON r.node = n.node),
""" + HISTORY_TAIL)
def _(spark, d):
    changes = checkpointed(renames(spark, d))
    touches, reads = N.lineages(changes)
    sizes = changes.groupBy("idx").agg(F.count(F.lit(1)).alias("n_changes"))
    f = facts(spark, d).join(sizes, "idx", "left").na.fill(0, ["n_changes"])
    return H.file_history(f, touches.select("idx", "lineage"), reads).drop("idx")
