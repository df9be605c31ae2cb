"""Registered queries: messages, lines, patches, file mixes and kinds of change."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lines as N
from ..functions import text as T
from ..functions.paths import tree_glob
from ..operators import diff as D
from ..operators import globs as G
from ..operators import intrinsic as I
from .registering import Collector
from .views import cte, facts, table, view

query = Collector()
QUERIES, ORACLES = query.queries, query.oracles

PARSED = cte("messages") + r""", heads AS (SELECT *, regexp_replace(message, '^\n+', '') AS t FROM messages),
 parsed AS (SELECT sha, author_name, author_email,
   trim(regexp_replace(CASE WHEN contains(t, chr(10) || chr(10)) THEN substr(t, 1, instr(t, chr(10) || chr(10)) - 1) ELSE t END, '\s+', ' ', 'g')) AS subject,
   CASE WHEN contains(t, chr(10) || chr(10)) THEN substr(t, instr(t, chr(10) || chr(10)) + 2) ELSE '' END AS body FROM heads),
 lined AS (SELECT sha, string_split(regexp_replace(regexp_replace(body, '(?s)<!--.*?-->', '', 'g'), '\n$', ''), chr(10)) AS l FROM parsed),
 kept AS (SELECT sha, l, list_filter(l, lambda x: NOT regexp_matches(x, '(?i)^\s*(signed-off-by|co-authored-by|reviewed-by|acked-by|tested-by|reported-by|suggested-by|helped-by|cc)\s*:')) AS k FROM lined),
 bodies AS (SELECT sha, regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(
     regexp_replace(array_to_string(list_transform(k, lambda x: regexp_replace(x, '\s+\([^()\n]*\bago\)\s+\[[^\]\n]*\]\s*$', '')), chr(10)),
       '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}', '<email>', 'g'), chr(10)), lambda x: regexp_replace(x, '\s+$', '')), chr(10)),
     '(?m)^```[^\n]*\n```[ \t]*$\n?', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS clean FROM kept)"""


def parsed(spark, d):
    subject, body = T.split_message(F.col("message"))
    return view(spark, d, "messages").select("sha", "message", "author_name", "author_email", subject.alias("subject"), body.alias("body"))


@query("f01_message_split", PARSED + " SELECT sha, subject, md5(body) AS body_md5, CAST(length(body) AS BIGINT) AS body_length FROM parsed")
def _(spark, d):
    return parsed(spark, d).select("sha", "subject", F.md5("body").alias("body_md5"), F.length("body").cast("bigint").alias("body_length"))


@query("f02_subject_tags", PARSED + r""", raw AS (SELECT sha, CASE WHEN regexp_matches(subject, '^\s*(\[[^\]\n]+\]\s*)+')
   THEN list_transform(regexp_extract_all(regexp_extract(subject, '^\s*((?:\[[^\]\n]+\]\s*)+)', 1), '\[([^\]\n]+)\]', 1), lambda x: lower(trim(x)))
   ELSE [lower(regexp_extract(subject, '^([A-Za-z0-9_./-]{1,40}):\s', 1))] END AS l FROM parsed)
 SELECT sha, array_to_string(list_filter(CASE WHEN len(l) = 2 AND l[1] = l[2] THEN l[:1] ELSE l END, lambda x: x <> ''), '|') AS tags FROM raw""")
def _(spark, d):
    return parsed(spark, d).select("sha", F.array_join(T.subject_tags(F.col("subject")), "|").alias("tags"))


@query("f03_pr_numbers", PARSED + r""" SELECT sha, TRY_CAST(nullif(regexp_extract(subject, '\(#(\d+)\)\s*$', 1), '') AS BIGINT) AS suffix,
 TRY_CAST(nullif(regexp_extract_all(subject, '\(#(\d+)\)', 1)[-1], '') AS BIGINT) AS last_pr,
 coalesce(TRY_CAST(nullif(regexp_extract(subject, '(?i)\bPR\s*#?\s*(\d+)|#(\d+)', 1), '') AS BIGINT),
   TRY_CAST(nullif(regexp_extract(subject, '(?i)\bPR\s*#?\s*(\d+)|#(\d+)', 2), '') AS BIGINT)) AS reference FROM parsed""")
def _(spark, d):
    s = F.col("subject")
    return parsed(spark, d).select("sha", T.pr_suffix(s).alias("suffix"), T.last_pr(s).alias("last_pr"), T.pr_reference(s).alias("reference"))


UNWRAP = r""", levels(sha, depth, cur, first_inner) AS (SELECT sha, 0, trim(subject), trim(subject) FROM parsed
  UNION ALL SELECT sha, depth + 1, trim(regexp_extract(cur, '(?i)^\s*revert\s*:?\s*"(.*)"(?:\s*\(#\d+\))*\s*$', 1)),
   CASE WHEN depth = 0 THEN trim(regexp_extract(cur, '(?i)^\s*revert\s*:?\s*"(.*)"(?:\s*\(#\d+\))*\s*$', 1)) ELSE first_inner END
  FROM levels WHERE regexp_matches(cur, '(?i)^\s*revert\s*:?\s*".*"(?:\s*\(#\d+\))*\s*$')),
 deepest AS (SELECT sha, max(depth) AS depth, arg_max(cur, depth) AS cur, arg_max(first_inner, depth) AS first_inner FROM levels GROUP BY sha),
 bares AS (SELECT *, depth = 0 AND regexp_matches(cur, '(?i)^\s*revert\b') AS bare,
   trim(regexp_replace(regexp_extract(cur, '(?i)^\s*revert\b\s*:?\s*(.*)$', 1), '(?:\s*\(#\d+\))+\s*$', '')) AS bare_inner FROM deepest),
 unwrapped AS (SELECT sha, CASE WHEN bare THEN 1 ELSE depth END AS depth, CASE WHEN bare THEN bare_inner ELSE cur END AS innermost,
   CASE WHEN bare THEN bare_inner ELSE first_inner END AS first_inner, bare FROM bares)"""


@query("f04_revert_unwrap", PARSED.replace("WITH", "WITH RECURSIVE", 1) + UNWRAP
       + " SELECT sha, CAST(depth AS BIGINT) AS depth, innermost, first_inner, bare FROM unwrapped")
def _(spark, d):
    u = parsed(spark, d).select("sha", T.unwrap_reverts(F.col("subject")).alias("u"))
    return u.select("sha", F.col("u.depth").cast("bigint").alias("depth"), "u.innermost", "u.first_inner", "u.bare")


@query("f04_reverted_refs", PARSED.replace("WITH", "WITH RECURSIVE", 1) + UNWRAP + r""" SELECT u.sha,
 CASE WHEN depth > 0 THEN nullif(regexp_extract(clean, 'This reverts commit ([0-9a-f]{7,40})', 1), '') END AS reverts_sha,
 CASE WHEN depth > 0 THEN coalesce(CASE WHEN bare THEN coalesce(TRY_CAST(nullif(regexp_extract(first_inner, '(?i)\bPR\s*#?\s*(\d+)|#(\d+)', 1), '') AS BIGINT),
    TRY_CAST(nullif(regexp_extract(first_inner, '(?i)\bPR\s*#?\s*(\d+)|#(\d+)', 2), '') AS BIGINT))
   ELSE TRY_CAST(nullif(regexp_extract(first_inner, '\(#(\d+)\)\s*$', 1), '') AS BIGINT) END,
  TRY_CAST(nullif(regexp_extract(clean, '(?i)\breverts?\s+(?:[\w.-]+/[\w.-]+)?#(\d+)', 1), '') AS BIGINT)) END AS reverts_pr
 FROM unwrapped u JOIN bodies USING (sha)""")
def _(spark, d):
    m = parsed(spark, d).select("sha", T.unwrap_reverts(F.col("subject")).alias("u"), T.clean_body(F.col("message")).alias("clean"))
    sha, pr = T.reverted_refs(F.col("clean"), F.col("u"))
    return m.select("sha", sha.alias("reverts_sha"), pr.alias("reverts_pr"))


@query("f05_trailers", PARSED + r""" SELECT sha, CAST(len(list_filter(l, lambda x: regexp_matches(x, '(?i)^\s*signed-off-by\s*:'))) AS BIGINT) AS signed_off_by,
 CAST(len(list_filter(l, lambda x: regexp_matches(x, '(?i)^\s*co-authored-by\s*:'))) AS BIGINT) AS co_authored_by,
 CAST(len(list_filter(l, lambda x: regexp_matches(x, '(?i)^\s*(reviewed-by|acked-by|tested-by|reported-by|suggested-by|helped-by|cc)\s*:'))) AS BIGINT) AS other,
 CAST(len(k) AS BIGINT) AS kept FROM kept""")
def _(spark, d):
    body = T.lines(T.without_comments(F.col("body")))
    rows = parsed(spark, d).select("sha", T.trailer_counts(body).alias("t"), F.size(T.strip_trailers(body)).alias("kept"))
    return rows.select("sha", *[F.col(f"t.{n}").cast("bigint").alias(n) for n in ("signed_off_by", "co_authored_by", "other")],
                       F.col("kept").cast("bigint").alias("kept"))


@query("f06_clean_body", PARSED + " SELECT sha, md5(clean) AS body_md5, CAST(length(clean) AS BIGINT) AS body_length, left(clean, 60) AS head FROM bodies")
def _(spark, d):
    rows = parsed(spark, d).select("sha", T.clean_body(F.col("message")).alias("clean"))
    return rows.select("sha", F.md5("clean").alias("body_md5"), F.length("clean").cast("bigint").alias("body_length"), F.left("clean", F.lit(60)).alias("head"))


@query("f07_sections", PARSED + r""", ls AS (SELECT sha, i, l[i] AS line FROM (SELECT sha, string_split(clean, chr(10)) AS l FROM bodies), unnest(range(1, len(l) + 1)) AS u(i)),
 hs AS (SELECT *, regexp_matches(line, '^\s*(?:#{1,6}\s*|\*\*\s*-?\s*)([^#*\n]+?)\s*(?:\*\*)?\s*:?\s*$') AND regexp_matches(line, '^\s*(#|\*\*)') AS h FROM ls),
 gs AS (SELECT *, max(CASE WHEN h THEN i END) OVER (PARTITION BY sha ORDER BY i) AS at FROM hs),
 secs AS (SELECT g.sha, g.i, g.line, CASE lower(regexp_extract(x.line, '^\s*(?:#{1,6}\s*|\*\*\s*-?\s*)([^#*\n]+?)\s*(?:\*\*)?\s*:?\s*$', 1))
    WHEN 'why i did it' THEN 'why' WHEN 'how to verify it?' THEN 'verify' END AS name FROM gs g JOIN ls x ON x.sha = g.sha AND x.i = g.at WHERE NOT g.h),
 texts AS (SELECT sha, name, left(regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g'), 6000) AS text FROM secs WHERE name IS NOT NULL GROUP BY sha, name)
 SELECT b.sha, md5(w.text) AS why, v.text AS verify FROM bodies b LEFT JOIN texts w ON w.sha = b.sha AND w.name = 'why' AND w.text <> ''
 LEFT JOIN texts v ON v.sha = b.sha AND v.name = 'verify' AND v.text <> ''""")
def _(spark, d):
    rows = parsed(spark, d).select("sha", T.clean_body(F.col("message")).alias("clean"))
    found = rows.select("sha", T.sections(F.col("clean"), T.SECTION_MAX_CHARS).alias("s"))
    return found.select("sha", F.md5("s.why").alias("why"), F.col("s.verify").alias("verify"))


@query("f07_sections_whole", ORACLES["f07_sections"].replace("left(regexp_replace(string_agg", "(regexp_replace(string_agg").replace(", 6000) AS text", ") AS text"))
def _(spark, d):
    rows = parsed(spark, d).select("sha", T.clean_body(F.col("message")).alias("clean"))
    found = rows.select("sha", T.sections(F.col("clean")).alias("s"))
    return found.select("sha", F.md5("s.why").alias("why"), F.col("s.verify").alias("verify"))


@query("f08_email_redaction", r"""SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}', '<email>', 'g')) AS redacted FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.redact_emails(F.col("text"))).alias("redacted"))


@query("f09_name_redaction")
def _(spark, d):
    redact = T.name_redactor(["Than The", "User Onthe", "Avec De", "onthe"])
    rows = table(spark, d, "documents").select("doc_id", redact("text").alias("redacted"))
    return rows.select("doc_id", F.md5("redacted").alias("redacted_md5"),
                       F.size(F.regexp_extract_all("redacted", F.lit(T.NAME_PLACEHOLDER), 0)).alias("names"))


@query("f10_pseudonym", cte("messages") + " SELECT sha, left(sha256(concat('salt-1', chr(0), lower(trim(author_email)))), 16) AS author_id FROM messages")
def _(spark, d):
    return view(spark, d, "messages").select("sha", T.pseudonym(F.col("author_email"), "salt-1").alias("author_id"))


@query("f11_pulled_lines", PARSED + r""" SELECT sha, CAST(len(list_filter(list_transform(k, lambda x: regexp_extract(x, '^\s*\*?\s*([0-9a-f]{7,40})\s+(?:-\s+)?\S', 1)),
 lambda x: regexp_matches(x, '\d'))) AS BIGINT) AS pulled FROM kept""")
def _(spark, d):
    kept = T.strip_trailers(T.lines(T.without_comments(F.col("body"))))
    return parsed(spark, d).select("sha", T.pulled_lines(kept).cast("bigint").alias("pulled"))


@query("f14_mention_text", PARSED + r""" SELECT sha, md5(regexp_replace(regexp_replace(regexp_replace(body, '(?m)^[A-Za-z][A-Za-z-]*-by:.*$', '', 'g'), '\S+@\S+', '', 'g'), 'https?://\S+', '', 'g')) AS text_md5 FROM parsed""")
def _(spark, d):
    return parsed(spark, d).select("sha", F.md5(T.mention_text(F.col("body"))).alias("text_md5"))


@query("p10_revert_predicates", PARSED + r""" SELECT sha, starts_with(subject, 'Revert') OR starts_with(regexp_replace(subject, '^(?:\[.*?\]\s*)+', ''), 'Revert') AS is_revert,
 starts_with(subject, 'Revert') AS is_headline FROM parsed""")
def _(spark, d):
    s = F.concat(F.when(F.col("sha") % 5 == 0, "").otherwise(""), F.col("subject"))
    return parsed(spark, d).select("sha", T.is_revert(s).alias("is_revert"), T.is_headline_revert(s).alias("is_headline"))


@query("p11_bot_predicate", cte("messages") + """ SELECT sha, contains(lower(author_name), '[bot]') OR contains(lower(split_part(author_email, '@', 1)), 'user3') AS is_bot FROM messages""")
def _(spark, d):
    return view(spark, d, "messages").select("sha", T.is_bot(F.col("author_name"), F.col("author_email"), ["[bot]", "user3"]).alias("is_bot"))


@query("a34_identity_names", cte("messages") + " SELECT DISTINCT name FROM (SELECT author_name AS name FROM messages UNION ALL SELECT trim(split_part(author_email, '@', 1)) FROM messages) WHERE name <> ''")
def _(spark, d):
    names = F.array("author_name", F.trim(F.substring_index("author_email", "@", 1)))
    return view(spark, d, "messages").select(F.explode(names).alias("name")).filter("name <> ''").distinct()


@query("f16_safe_url", r"""SELECT page_id, kind, CASE kind WHEN 0 THEN regexp_replace(url, '[?#].*$', '') WHEN 1 THEN regexp_replace(url, '[?#].*$', '')
 WHEN 2 THEN concat('git.host:org/', page_id) ELSE NULL END AS safe FROM (SELECT page_id, url, CAST(page_id % 5 AS BIGINT) AS kind FROM pages)""")
def _(spark, d):
    url = F.expr("""CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://me:pw@') WHEN 2 THEN concat('git@git.host:org/', page_id)
        WHEN 3 THEN concat('file:///x/', page_id) ELSE '/local/path' END""")
    return table(spark, d, "pages").select("page_id", F.expr("page_id % 5").alias("kind"), T.safe_url(url).alias("safe"))


@query("f17_path_words", cte("page_paths") + """ SELECT page_id, array_to_string(regexp_extract_all(path, '[A-Za-z][A-Za-z0-9]+'), ' ') AS words FROM page_paths""")
def _(spark, d):
    return view(spark, d, "page_paths").select("page_id", T.path_words(F.col("path")).alias("words"))


@query("f19_epoch_iso", """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(floor(epoch(ts)) AS BIGINT) AS epoch,
 CAST(floor(epoch(ts) / 86400) AS BIGINT) AS days FROM events""")
def _(spark, d):
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").select("event_id", T.utc_text(epoch).alias("iso"))
    return rows.select("event_id", "iso", T.utc_epoch(F.col("iso")).alias("epoch"), F.floor(T.utc_epoch(F.col("iso")) / 86400).alias("days"))


@query("f27_token_estimate", "SELECT doc_id, CAST(length(text) // 3 + 1 AS BIGINT) AS tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


COMMENT = r"""CASE WHEN t = '' THEN 'blank' WHEN starts_with(t, '#!/') THEN 'code'
 WHEN path IN ('a/x.py', 'src/Makefile') AND starts_with(t, '#') THEN 'comment'
 WHEN path IN ('b/x.c', 'conf/x.c.j2') AND (regexp_matches(t, '^(//|/\*|\*/|\* |\*\t)') OR t = '*') THEN 'comment'
 WHEN path = 'conf/x.c.j2' AND starts_with(t, '{#') THEN 'comment' WHEN path = 'README.md' AND starts_with(t, '<!--') THEN 'comment' ELSE 'code' END"""


@query("f12_line_kind", cte("patches") + rf""", c AS (SELECT sha, path, regexp_replace(substr(line, 2), '^\s+|\s+$', '', 'g') AS t FROM patches WHERE regexp_matches(line, '^[+-]'))
 SELECT sha, path, kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT sha, path, {COMMENT} AS kind FROM c) GROUP BY ALL""")
def _(spark, d):
    rows = D.patch_lines(view(spark, d, "patches")).filter(F.left("line", F.lit(1)).isin("+", "-"))
    kind = N.line_kind(F.substr("line", F.lit(2)), N.comment_markers(F.col("path")))
    return rows.select("sha", "path", kind.alias("kind")).groupBy("sha", "path", "kind").agg(F.count(F.lit(1)).alias("n"))


SQUEEZE = r"""array_to_string(list_transform(regexp_extract_all(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '"(?:[^"\\]|\\.)*"?|''(?:[^''\\]|\\.)*''?|[^"''\s]+|\s+'),
 lambda p: CASE WHEN regexp_matches(p, '^\s') THEN ' ' ELSE p END), '')"""


@query("f13_squeeze", f"SELECT doc_id, md5({SQUEEZE.format(c='t')}) AS squeezed FROM (SELECT doc_id, replace(concat('  ', text, ' \"a  b\"  c'), ' ', '  ') AS t FROM documents)")
def _(spark, d):
    text = F.replace(F.concat(F.lit("  "), "text", F.lit(' "a  b"  c')), F.lit(" "), F.lit("  "))
    return table(spark, d, "documents").select("doc_id", F.md5(N.squeeze(text)).alias("squeezed"))


NUMBERED = r""", marked AS (SELECT *, regexp_matches(line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@') AS h FROM patches),
 hunked AS (SELECT *, count(*) FILTER (h) OVER (PARTITION BY sha, path ORDER BY pos) AS hunk,
   CASE WHEN h THEN 'header' WHEN line[1] = '+' THEN 'added' WHEN line[1] = '-' THEN 'removed' WHEN line[1] = '\' THEN 'note' ELSE 'context' END AS kind FROM marked),
 starts AS (SELECT *, max(CASE WHEN h THEN CAST(regexp_extract(line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', 1) AS BIGINT) END) OVER (PARTITION BY sha, path, hunk) AS os,
   max(CASE WHEN h THEN CAST(regexp_extract(line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', 3) AS BIGINT) END) OVER (PARTITION BY sha, path, hunk) AS ns FROM hunked),
 numbered AS (SELECT sha, path, pos, hunk, kind, substr(line, 2) AS content,
   CASE WHEN kind IN ('removed', 'context') THEN os + count(*) FILTER (kind IN ('removed', 'context')) OVER (PARTITION BY sha, path, hunk ORDER BY pos) - 1 END AS old_lineno,
   CASE WHEN kind IN ('added', 'context') THEN ns + count(*) FILTER (kind IN ('added', 'context')) OVER (PARTITION BY sha, path, hunk ORDER BY pos) - 1 END AS new_lineno
   FROM starts WHERE hunk > 0)"""


@query("w11_line_numbers", cte("patches") + NUMBERED + " SELECT sha, path, pos, hunk, kind, md5(content) AS content, old_lineno, new_lineno FROM numbered")
def _(spark, d):
    rows = D.number_lines(D.patch_lines(view(spark, d, "patches")))
    return rows.withColumn("content", F.md5("content")).withColumn("pos", F.col("pos").cast("bigint"))


@query("w11_hunk_ranges", cte("patches") + r""" SELECT sha, pos, CAST(regexp_extract(line, '^@@ -(\d+)', 1) AS BIGINT) AS old_start, 3::BIGINT AS old_count,
 CAST(regexp_extract(line, '\+(\d+)', 1) AS BIGINT) AS new_start, 1::BIGINT AS new_count FROM patches WHERE pos % 9 = 0""")
def _(spark, d):
    rows = D.hunk_ranges(D.patch_lines(view(spark, d, "patches"))).drop("path")
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


CAPPED = r""", keep AS (SELECT *, row_number() OVER (PARTITION BY sha, path ORDER BY pos) AS n, count(*) OVER (PARTITION BY sha, path) AS n_lines FROM patches WHERE regexp_matches(line, '^(@@ -\d|[+\\-])')),
 capped AS (SELECT sha, path, n, CASE WHEN strlen(line) > 200 THEN concat(line[1], '<line omitted: ', strlen(line), ' bytes>') ELSE line END AS line, strlen(line) > 200 AS omitted, n_lines, n_lines > 12 AS truncated
   FROM keep WHERE n <= 12)"""


@query("w12_line_caps", cte("patches") + CAPPED + " SELECT sha, path, n, md5(line) AS line, omitted, n_lines, truncated FROM capped")
def _(spark, d):
    rows = D.cap_lines(D.patch_lines(view(spark, d, "patches")), max_lines=12, max_bytes=200)
    return rows.withColumn("line", F.md5("line")).withColumn("n", F.col("n").cast("bigint"))


@query("w12_lines_whole", cte("patches") + CAPPED.split(",\n capped AS")[0] + " SELECT sha, path, n, md5(line) AS line, n_lines FROM keep")
def _(spark, d):
    rows = D.cap_lines(D.patch_lines(view(spark, d, "patches"))).select("sha", "path", "n", "line", "n_lines")
    return rows.withColumn("line", F.md5("line")).withColumn("n", F.col("n").cast("bigint"))


@query("w12_commit_budget", cte("patches").replace("WITH", "WITH RECURSIVE", 1) + CAPPED + """, seqd AS (SELECT sha // 4 AS c, sha AS file_no, n, strlen(line) + 1 AS size,
   row_number() OVER (PARTITION BY sha // 4 ORDER BY sha, n) AS i FROM capped),
 walk(c, i, file_no, remaining, stopped, took) AS (SELECT c, i, file_no, CASE WHEN size <= 1500 THEN 1500 - size ELSE 1500 END, size > 1500, size <= 1500 FROM seqd WHERE i = 1
  UNION ALL SELECT s.c, s.i, s.file_no,
   CASE WHEN NOT (w.stopped AND w.file_no = s.file_no) AND s.size <= w.remaining THEN w.remaining - s.size ELSE w.remaining END,
   (w.stopped AND w.file_no = s.file_no) OR s.size > w.remaining,
   NOT (w.stopped AND w.file_no = s.file_no) AND s.size <= w.remaining FROM walk w JOIN seqd s ON s.c = w.c AND s.i = w.i + 1)
 SELECT c AS sha, file_no, CAST(count(*) FILTER (took) AS BIGINT) AS kept, bool_or(stopped) AS truncated, count(*) AS n_lines FROM walk GROUP BY c, file_no""")
def _(spark, d):
    rows = D.cap_lines(D.patch_lines(view(spark, d, "patches")), max_lines=12, max_bytes=200)
    return D.commit_budget(rows.select(F.floor(F.col("sha") / 4).alias("sha"), F.col("sha").alias("file_no"), "n", "line"), budget=1500)


@query("u04_line_pairing", cte("patches") + NUMBERED + rf""", ch AS (SELECT sha, path, hunk, kind, regexp_replace(content, '^\s+|\s+$', '', 'g') AS t,
   concat(CASE WHEN path IN ('a/x.py', 'src/Makefile') THEN regexp_extract(content, '^(\s*)', 1) ELSE '' END, {SQUEEZE.format(c='content')}) AS text
   FROM numbered WHERE kind IN ('added', 'removed')),
 kinds AS (SELECT *, {COMMENT} AS what FROM ch),
 grouped AS (SELECT sha, path, hunk, text, what, count(*) FILTER (kind = 'added') AS a, count(*) FILTER (kind = 'removed') AS r,
   CASE WHEN what = 'blank' THEN 0 ELSE least(count(*) FILTER (kind = 'added'), count(*) FILTER (kind = 'removed')) END AS p FROM kinds GROUP BY sha, path, hunk, text, what)
 SELECT sha, path, CAST(sum(CASE WHEN what = 'blank' THEN a ELSE 0 END) AS BIGINT) AS blank_added, CAST(sum(CASE WHEN what = 'blank' THEN r ELSE 0 END) AS BIGINT) AS blank_removed,
  CAST(sum(p) AS BIGINT) AS whitespace_only, CAST(sum(CASE WHEN what = 'comment' THEN a - p ELSE 0 END) AS BIGINT) AS comment_added,
  CAST(sum(CASE WHEN what = 'comment' THEN r - p ELSE 0 END) AS BIGINT) AS comment_removed FROM grouped GROUP BY sha, path""")
def _(spark, d):
    return D.changed_line_kinds(D.number_lines(D.patch_lines(view(spark, d, "patches"))))


@query("w13_first_run", cte("patches") + NUMBERED + """, c AS (SELECT *, row_number() OVER (PARTITION BY sha, path, kind ORDER BY pos) AS nth FROM numbered WHERE kind IN ('added', 'removed')),
 r AS (SELECT *, pos - nth = min(pos) OVER (PARTITION BY sha, path, kind) - 1 AS first FROM c)
 SELECT sha, path, kind, min(CASE kind WHEN 'added' THEN new_lineno ELSE old_lineno END) AS line_start,
  max(CASE kind WHEN 'added' THEN new_lineno ELSE old_lineno END) AS line_end, md5(string_agg(content, chr(10) ORDER BY pos)) AS quote
 FROM r WHERE first GROUP BY sha, path, kind""")
def _(spark, d):
    return D.first_runs(D.number_lines(D.patch_lines(view(spark, d, "patches")))).withColumn("quote", F.md5("quote"))


@query("w14_latest_diff", cte("facts", "changes") + """ SELECT path, max(idx) AS idx, arg_max(additions, (idx, additions, deletions)) AS additions,
 arg_max(deletions, (idx, additions, deletions)) AS deletions FROM changes JOIN facts USING (sha) GROUP BY path""")
def _(spark, d):
    rows = view(spark, d, "changes").join(facts(spark, d).select("sha", "idx"), "sha")
    return D.latest_per_path(rows.select("path", "idx", "additions", "deletions"), ("path",), ("idx", "additions", "deletions"))


@query("w14_widest_class", cte("changes") + """ SELECT path, min(deletions) AS rank, arg_min(additions, (deletions, sha, additions)) AS additions FROM changes GROUP BY path""")
def _(spark, d):
    rows = view(spark, d, "changes").select("path", F.col("deletions").alias("rank"), "sha", "additions")
    return D.widest_per_path(rows, ("path",), "rank", ("sha", "additions")).drop("sha")


CLASSES = """CASE WHEN is_binary THEN 'binary' WHEN path LIKE '%7' THEN 'test' WHEN path LIKE '%3' THEN 'doc' WHEN path LIKE '%1' THEN 'submodule' ELSE 'code' END"""


@query("a07_intrinsic_features", cte("changes") + f""", f AS (SELECT *, CASE WHEN is_binary THEN 0 ELSE additions END AS a, CASE WHEN is_binary THEN 0 ELSE deletions END AS x, {CLASSES} AS cls FROM changes)
 SELECT sha, CAST(count(*) AS BIGINT) AS file_count, CAST(sum(a) AS BIGINT) AS additions, CAST(sum(x) AS BIGINT) AS deletions, CAST(sum(a) + sum(x) AS BIGINT) AS churn,
  CAST(count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS BIGINT) AS directory_count, CAST(count(DISTINCT split_part(path, '/', 1)) AS BIGINT) AS subsystem_count,
  3::BIGINT AS max_path_depth, CAST(count(*) FILTER (status = 'A') AS BIGINT) AS added_file_count, CAST(count(*) FILTER (status = 'M') AS BIGINT) AS modified_file_count,
  bool_and(cls = 'doc') AS is_doc_only, bool_and(cls = 'test') AS is_test_only, bool_and(cls = 'submodule') AS is_submodule_only, bool_or(cls = 'test') AS touches_tests,
  CAST(count(*) FILTER (cls = 'code') AS BIGINT) AS code_file_count FROM f GROUP BY sha""")
def _(spark, d):
    return features(spark, d).select(
        "sha", "file_count", "additions", "deletions", "churn", "directory_count", "subsystem_count", "max_path_depth", "added_file_count",
        "modified_file_count", "is_doc_only", "is_test_only", "is_submodule_only", "touches_tests", "code_file_count")


def features(spark, d):
    files = view(spark, d, "changes").withColumn("file_class", F.expr(CLASSES)).withColumnRenamed("is_binary", "binary")
    return I.commit_features(files)


@query("a08_change_entropy", cte("changes") + """, w AS (SELECT sha, additions + deletions AS w, sum(additions + deletions) OVER (PARTITION BY sha) AS t FROM changes WHERE NOT is_binary),
 e AS (SELECT sha, abs(round(coalesce(-sum(CASE WHEN w > 0 THEN (w / CAST(t AS DOUBLE)) * log2(w / CAST(t AS DOUBLE)) END), 0), 6)) AS entropy FROM w GROUP BY sha),
 n AS (SELECT sha, count(*) AS files FROM changes GROUP BY sha)
 SELECT n.sha, coalesce(entropy, 0) AS entropy, CASE WHEN files > 1 THEN round(coalesce(entropy, 0) / log2(files), 6) ELSE 0 END AS entropy_normalized FROM n LEFT JOIN e USING (sha)""")
def _(spark, d):
    return features(spark, d).select("sha", "entropy", "entropy_normalized")


# What an order touches: documents, tests, pins or CI files only, or a mix by part.
KIND = "CASE l_orderkey % 8 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 6 ELSE l_partkey % 9 END"
KIND_PATHS = f"""CASE {KIND} WHEN 0 THEN concat('device/acme/x-', l_suppkey, '/u', l_partkey % 5, '/port.ini') WHEN 1 THEN 'platform/chip/docker-syncd/Makefile'
 WHEN 2 THEN 'docs/a.md' WHEN 3 THEN 'tests/t.py' WHEN 4 THEN 'requirements-dev.txt' WHEN 5 THEN '.github/x.yml' WHEN 6 THEN concat('src/sub', l_suppkey % 7)
 WHEN 7 THEN concat('rules/docker-', l_suppkey % 7, '.mk') ELSE 'dockers/docker-lldp/x.c' END"""
KIND_CLASS = f"""CASE {KIND} WHEN 2 THEN 'doc' WHEN 3 THEN 'test' WHEN 4 THEN 'config' WHEN 5 THEN 'build' WHEN 6 THEN 'submodule' ELSE 'code' END"""
KIND_FILES = f"""SELECT l_orderkey % 1000 AS sha, CASE l_returnflag WHEN 'A' THEN 'A' ELSE 'M' END AS status, {KIND_PATHS} AS path, {KIND_CLASS} AS file_class
 FROM lineitem"""


def kind_files(spark, d):
    return spark.sql(KIND_FILES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, d, "lineitem"))


@query("p01_change_types", PARSED + ", files AS (" + KIND_FILES + r"""),
 per AS (SELECT sha, count(*) AS n, count(*) FILTER (file_class = 'submodule' AND status = 'M') AS moved, bool_and(file_class IN ('submodule', 'build', 'config', 'doc', 'other')) AS plain,
   count(*) FILTER (file_class = 'doc') AS docs, count(*) FILTER (file_class = 'test') AS tests, count(*) FILTER (starts_with(path, 'requirements')) AS pins,
   count(*) FILTER (status = 'A' AND starts_with(path, 'device/')) AS devices, count(*) FILTER (starts_with(path, 'device/') OR starts_with(path, 'platform/')) AS hw,
   count(*) FILTER (starts_with(path, '.github/') OR file_class = 'build') AS builds FROM files GROUP BY sha),
 r AS (SELECT p.sha, p.subject, b.clean, coalesce(f.n, 0) AS n, coalesce(moved, 0) AS moved, plain, coalesce(docs, 0) AS docs, coalesce(tests, 0) AS tests, coalesce(pins, 0) AS pins,
   coalesce(devices, 0) AS devices, coalesce(hw, 0) AS hw, coalesce(builds, 0) AS builds FROM parsed p JOIN bodies b USING (sha) LEFT JOIN per f USING (sha)),
 t AS (SELECT sha, list_filter([
   CASE WHEN starts_with(subject, 'Revert') THEN 'revert' END,
   CASE WHEN moved > 0 AND plain THEN 'submodule-bump' END,
   CASE WHEN n > 0 AND docs = n THEN 'docs' END,
   CASE WHEN n > 0 AND tests = n THEN 'test' END,
   CASE WHEN contains(lower(subject), 'dependabot') OR (moved = 0 AND regexp_matches(subject, '(?i)\b(bump|upgrade|update|uprev)s?\b.*?(\bv?\d+(\.\d+)+\b|\bversions?\b|\bfrom\b.*\bto\b)'))
      OR (n > 0 AND pins = n) THEN 'dependency-bump' END,
   CASE WHEN (devices > 0 AND hw * 2 >= n) OR regexp_matches(subject, '(?i)\b(add|adding|added|support|introduce|new|onboard)\b.*?\b(platform|hwsku|sku|board|asic|chassis|linecard)s?\b') THEN 'platform-support' END,
   CASE WHEN regexp_matches(subject, '(?i)\b(fix(e[sd]|ing)?|bug(s|fix|fixes)?|hotfix|crash(es|ed)?|leak(s|ed)?|regression|broken|incorrect|wrong|hang(s|ing)?|race|deadlock|segfault|panic|core ?dump|workaround|cve-\d+|vulnerabilit(y|ies)|typo)\b')
      OR regexp_matches(clean, '(?im)^\s*(fix(es|ed)?|close[sd]?|resolve[sd]?)\s*:?\s*(#\d+|https://github\.com/\S+/issues/\d+)') THEN 'fix' END,
   CASE WHEN (n > 0 AND builds = n) OR regexp_matches(lower(subject), '^\[(ci|build)\]') THEN 'build-ci' END,
   CASE WHEN regexp_matches(subject, '(?i)^(\[[^\]]*\]\s*|[\w./-]+:\s*)*(add|adding|added|support|introduce|implement|enable|new)\b|\bfeature\b') THEN 'feature' END], lambda x: x IS NOT NULL) AS l FROM r)
 SELECT sha, coalesce(l[1], 'chore') AS change_type, CASE WHEN len(l) = 0 THEN 'chore' ELSE array_to_string(l, ',') END AS change_types,
  list_contains(l, 'fix') AND l[1] <> 'revert' AS fix_like FROM t""")
def _(spark, d):
    return change_types(spark, d).select("sha", "change_type", F.array_join("change_types", ",").alias("change_types"), "fix_like")


def change_types(spark, d):
    files = kind_files(spark, d).withColumn("new_path", F.col("path"))
    messages = parsed(spark, d).select(
        "sha", "subject", T.subject_tags(F.col("subject")).alias("tags"), T.clean_body(F.col("message")).alias("body"),
        T.is_headline_revert(F.col("subject")).alias("is_revert"))
    return I.change_types(messages, files)


RULES = [("docs", tree_glob("docs/**")), ("py", tree_glob("*.py")), ("images", tree_glob("dockers/**/*.c")), ("makefiles", tree_glob("Makefile")), ("rules", tree_glob("rules/*"))]
RULE_SQL = """ f AS (SELECT DISTINCT sha, path FROM (""" + KIND_FILES + r""")),
 m AS (SELECT sha, path, unnest([CASE WHEN starts_with(path, 'docs/') THEN 'docs' END, CASE WHEN path LIKE '%.py' THEN 'py' END,
   CASE WHEN regexp_full_match(path, 'dockers/(.*/)?[^/]*\.c') THEN 'images' END, CASE WHEN path = 'Makefile' OR path LIKE '%/Makefile' THEN 'makefiles' END,
   CASE WHEN regexp_full_match(path, 'rules/[^/]*') THEN 'rules' END]) AS component FROM f)"""


@query("p06_components", "WITH" + RULE_SQL + " SELECT sha, component, CAST(count(*) AS BIGINT) AS path_count FROM m WHERE component IS NOT NULL GROUP BY sha, component")
def _(spark, d):
    return I.components(kind_files(spark, d), RULES)


@query("p06_unmapped_paths", "WITH" + RULE_SQL + " SELECT sha, CAST(count(*) AS BIGINT) AS n FROM (SELECT sha, path FROM m GROUP BY sha, path HAVING count(component) = 0) GROUP BY sha")
def _(spark, d):
    return I.unmapped_paths(kind_files(spark, d), RULES).groupBy("sha").agg(F.count(F.lit(1)).alias("n"))


MANY = [*[(f"x-{n}", f"device/acme/x-{n}/**") for n in range(1, 1001)], *[(f"unit-{n}", f"device/**/u{n}/*.ini") for n in range(5)], ("sub", "src/sub?"), ("docker", "docker-*.mk")]
MANY_SQL = " f AS (SELECT DISTINCT sha, path FROM (" + KIND_FILES + r""")),
 m AS (SELECT sha, path, unnest([CASE WHEN starts_with(path, 'device/acme/x-') AND CAST(regexp_extract(path, 'x-([0-9]+)/', 1) AS BIGINT) BETWEEN 1 AND 1000 THEN regexp_extract(path, 'x-[0-9]+') END,
   CASE WHEN regexp_full_match(path, 'device/(.*/)?u[0-4]/[^/]*\.ini') THEN concat('unit-', regexp_extract(path, '/u([0-4])/', 1)) END,
   CASE WHEN regexp_full_match(path, 'src/sub.') THEN 'sub' END, CASE WHEN regexp_full_match(path, '(.*/)?docker-[^/]*\.mk') THEN 'docker' END]) AS rule FROM f)"""


@query("p05_glob_matches", "WITH" + MANY_SQL + " SELECT DISTINCT path, rule FROM m WHERE rule IS NOT NULL")
def _(spark, d):
    return G.matched(kind_files(spark, d), MANY)


@query("p06_components_many_rules", "WITH" + MANY_SQL + " SELECT sha, rule AS component, CAST(count(*) AS BIGINT) AS path_count FROM m WHERE rule IS NOT NULL GROUP BY sha, rule")
def _(spark, d):
    return G.glob_components(kind_files(spark, d), MANY)


@query("p06_unmatched_many_rules", "WITH" + MANY_SQL + " SELECT sha, path FROM m GROUP BY sha, path HAVING count(rule) = 0")
def _(spark, d):
    return G.unmatched(kind_files(spark, d), MANY)


@query("p07_feature_areas", "WITH f AS (" + KIND_FILES + """), a(area, prefix) AS (SELECT concat('n', n_nationkey), concat('device/acme/x-', n_nationkey) FROM nation UNION ALL VALUES ('docs', 'docs'), ('tests', 'tests/t.py'))
 SELECT sha, area, CAST(count(DISTINCT path) AS BIGINT) AS path_count FROM f JOIN a ON path = prefix OR starts_with(path, prefix || '/') GROUP BY sha, area""")
def _(spark, d):
    return I.feature_areas(kind_files(spark, d), area_prefixes(spark, d))


def area_prefixes(spark, d):
    return table(spark, d, "nation").selectExpr("concat('n', n_nationkey) AS area", "concat('device/acme/x-', n_nationkey) AS prefix").unionByName(
        spark.createDataFrame([("docs", "docs"), ("tests", "tests/t.py")], "area string, prefix string"))


@query("p08_path_entities", "WITH f AS (SELECT DISTINCT sha, path FROM (" + KIND_FILES + r""")),
 e AS (SELECT sha, path, 'vendor' AS kind, split_part(path, '/', 2) AS name FROM f WHERE starts_with(path, 'device/')
  UNION ALL SELECT sha, path, 'platform', split_part(path, '/', 3) FROM f WHERE starts_with(path, 'device/')
  UNION ALL SELECT sha, path, 'hwsku', split_part(path, '/', 4) FROM f WHERE starts_with(path, 'device/') AND split_part(path, '/', 4) <> 'u3'
  UNION ALL SELECT sha, path, 'asic', 'chip' FROM f WHERE starts_with(path, 'platform/')
  UNION ALL SELECT sha, path, 'docker', 'syncd' FROM f WHERE starts_with(path, 'platform/')
  UNION ALL SELECT sha, path, 'docker', 'lldp' FROM f WHERE starts_with(path, 'dockers/')
  UNION ALL SELECT sha, path, 'docker', regexp_extract(path, 'docker-(.+)\.mk', 1) FROM f WHERE starts_with(path, 'rules/')
  UNION ALL SELECT sha, path, 'submodule', concat('m-', path) FROM f WHERE starts_with(path, 'src/'))
 SELECT sha, kind, name, CAST(count(DISTINCT path) AS BIGINT) AS path_count FROM e GROUP BY ALL""")
def _(spark, d):
    files = kind_files(spark, d)
    links = files.filter("path LIKE 'src/%'").select("sha", "path", F.concat(F.lit("m-"), "path").alias("name"))
    return I.path_entities(files, links, hwsku_exclude=["u3"])


@query("p02_path_class", "SELECT DISTINCT path, " + """CASE WHEN path LIKE 'device/%port.ini' THEN 'ports' WHEN path LIKE 'd%' THEN 'd' WHEN regexp_full_match(path, 'src/sub[0-3]') THEN 'low' ELSE 'rest' END AS path_class FROM (""" + KIND_FILES + ")")
def _(spark, d):
    from ..functions.paths import first_match, shell_glob

    rules = [(shell_glob("device/*port.ini"), "ports"), (shell_glob("d*"), "d"), (shell_glob("src/sub[0-3]"), "low")]
    return kind_files(spark, d).select("path").distinct().withColumn("path_class", first_match(F.col("path"), rules, "rest"))


@query("p04_file_class", cte("changes") + """ SELECT DISTINCT path, CASE WHEN path LIKE '%11' THEN 'submodule' WHEN is_binary THEN 'binary' WHEN regexp_full_match(path, 'p/[0-9]/.*') THEN 'code'
 WHEN regexp_full_match(path, '(.*/)?[^/]*3') THEN 'doc' ELSE 'other' END AS file_class FROM changes""")
def _(spark, d):
    from ..functions.paths import first_match

    rules = [(tree_glob("p/?/**"), "code"), (tree_glob("*3"), "doc")]
    path = F.col("path")
    found = F.when(path.endswith("11"), "submodule").when(F.col("is_binary"), "binary").otherwise(first_match(path, rules, "other"))
    return view(spark, d, "changes").select("path", found.alias("file_class")).distinct()


@query("p19_one_hot_areas", cte("areas") + " SELECT sha, " + ", ".join(f"CAST(max(CASE WHEN area = 'Brand#{n}' THEN 1 ELSE 0 END) AS INT) AS \"area__Brand#{n}\"" for n in (1, 2, 3, 99)) + " FROM areas GROUP BY sha")
def _(spark, d):
    return I.one_hot(view(spark, d, "areas"), "area", [f"Brand#{n}" for n in (1, 2, 3, 99)], "area")


@query("p16_model_rows", cte("facts") + " SELECT sha FROM facts WHERE sha % 3 <> 0 AND NOT is_merge AND sha % 7 <> 0")
def _(spark, d):
    from ..operators.models import model_rows

    f = facts(spark, d).withColumn("split", F.expr("CASE sha % 3 WHEN 0 THEN 'gap' WHEN 1 THEN 'train' ELSE 'test' END"))
    return model_rows(f.withColumn("label_x", F.expr("CASE WHEN sha % 7 <> 0 THEN true END")), "x").select("sha")


@query("j06_line_origin_replay")
def _(spark, d):
    events = view(spark, d, "changes").join(facts(spark, d).select("sha", "idx"), "sha").groupBy("path", "idx", "sha").agg(
        F.max("additions").alias("a"), F.max("deletions").alias("r"))
    hunks = F.array(F.struct((F.col("r") + 1).alias("old_start"), F.col("r").alias("old_count"), (F.col("r") + 1).alias("new_start"), F.col("a").alias("new_count")))
    return D.replay_origins(events.select(F.col("path").alias("lineage"), "idx", F.col("sha").cast("string").alias("sha"), hunks.alias("hunks")))
