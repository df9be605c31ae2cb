"""Registered queries: the 52 intrinsic columns and the wide feature table with history, labels and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diff as D
from ..operators import features as W
from ..operators import history as H
from ..operators import intrinsic as I
from ..operators import labels as L
from ..operators import splits as S
from ..session import written
from . import history, text
from .registering import Collector
from .views import cte, facts, view, with_areas

query = Collector()
QUERIES, ORACLES = query.queries, query.oracles

COMPONENTS = tuple(name for name, _ in text.RULES)
BRANDS = tuple(f"Brand#{a}{b}" for a in range(1, 6) for b in range(1, 6))


def families(spark, d):
    """The inputs of the intrinsic columns: files, lines, areas, messages."""
    files = view(spark, d, "changes").withColumn("file_class", F.expr(text.CLASSES)).withColumnRenamed("is_binary", "binary")
    lines = written(D.patch_lines(view(spark, d, "patches")))
    totals = W.line_totals(D.changed_line_kinds(D.number_lines(lines)), W.hunk_scopes(lines))
    kinds = written(text.kind_files(spark, d).distinct())
    links = kinds.filter("path LIKE 'src/%'").select("sha", "path", F.concat(F.lit("m-"), "path").alias("name"))
    places = text.area_prefixes(spark, d)
    areas = W.area_counts(I.components(kinds, text.RULES), I.feature_areas(kinds, places), I.path_entities(kinds, links, hwsku_exclude=["u3"]), I.unmapped_paths(kinds, text.RULES))
    body = T.lines(T.without_comments(F.col("body")))
    parsed = text.parsed(spark, d).withColumn("clean", T.clean_body(F.col("message")))
    messages = W.message_columns(parsed.select(
        "sha", "subject", F.length("clean").cast("bigint").alias("body_length"), T.subject_tags(F.col("subject")).alias("tags"), T.pr_suffix(F.col("subject")).alias("pr_number"),
        T.sections(F.col("clean")).alias("sections"), T.pulled_lines(T.strip_trailers(body)).cast("bigint").alias("pulled_commit_lines"),
        T.trailer_counts(body)["co_authored_by"].cast("bigint").alias("co_author_count")))
    return files, totals, areas, messages


def intrinsic(spark, d, commits):
    files, lines, areas, messages = families(spark, d)
    return W.intrinsic_features(commits, files, lines, areas, messages)


def history_families(spark, d, f):
    areas = written(with_areas(spark, d, f, "idx", "author_id", "landed"))
    return [
        H.author_prior(f), H.author_area_experience(f, areas.select("idx", "author_id", "area")), H.recent_experience(f),
        history.file_features(spark, d, f), H.area_history(f, areas.select("idx", "area"), L.link_reverts(f).select("target", "revert")),
        H.area_burst(f, areas.select("idx", "area", "landed"))]


def wide_table(spark, d):
    """The feature table of all derived commits, checked against its contract."""
    f = facts(spark, d)
    rows, ends = S.assign_splits(f)
    rows = written(rows)
    bots = text.parsed(spark, d).select("sha", T.is_bot(F.col("author_name"), F.col("author_email"), ["[bot]", "user3"]).alias("author_is_bot"))
    labels = L.split_labels(history.labels_of(spark, d, f).join(rows.select("idx", "split"), "idx"), ends)
    kinds = text.kind_files(spark, d)
    one_hot = {
        "component": (I.components(kinds, text.RULES).withColumnRenamed("component", "name"), COMPONENTS),
        "area": (view(spark, d, "areas").withColumnRenamed("area", "name"), BRANDS)}
    table = W.feature_table(
        rows.join(bots, "sha", "left"), text.change_types(spark, d), intrinsic(spark, d, f.select("sha")), history_families(spark, d, f), labels, one_hot)
    return W.checked(table, {prefix: names for prefix, (_, names) in one_hot.items()})


def _count(test: str, name: str) -> str:
    return f"CAST(count(*) FILTER ({test}) AS BIGINT) AS {name}"


SIZES = cte("changes") + f""", f AS (SELECT *, CASE WHEN is_binary THEN 0 ELSE additions END AS a, CASE WHEN is_binary THEN 0 ELSE deletions END AS x, {text.CLASSES} AS cls FROM changes)
 SELECT sha, CAST(count(*) AS BIGINT) AS file_count, CAST(sum(a) AS BIGINT) AS additions, CAST(sum(x) AS BIGINT) AS deletions, CAST(sum(a) + sum(x) AS BIGINT) AS churn,
  CAST(count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS BIGINT) AS directory_count, CAST(count(DISTINCT split_part(path, '/', 1)) AS BIGINT) AS subsystem_count,
  CAST(max(len(string_split(path, '/'))) AS BIGINT) AS max_path_depth, {_count("status = 'A'", "added_file_count")}, {_count("status = 'D'", "deleted_file_count")},
  {_count("status IN ('M', 'T')", "modified_file_count")}, {_count("status IN ('R', 'C')", "renamed_file_count")},
  {", ".join(_count(f"cls = '{name}'", f"{name}_file_count") for name in I.FILE_CLASSES)},
  bool_and(cls = 'doc') AS is_doc_only, bool_and(cls = 'test') AS is_test_only, bool_and(cls = 'submodule') AS is_submodule_only, bool_or(cls = 'test') AS touches_tests FROM f GROUP BY sha"""
PARTS = {
    "sizes": SIZES,
    "spread": text.ORACLES["a08_change_entropy"],
    "lines": f"""SELECT sha, CAST(sum(blank_added + blank_removed) AS BIGINT) AS blank_line_count, CAST(2 * sum(whitespace_only) AS BIGINT) AS whitespace_only_line_count,
 CAST(sum(comment_added + comment_removed) AS BIGINT) AS comment_line_count FROM ({text.ORACLES["u04_line_pairing"]}) GROUP BY sha""",
    "scopes": cte("patches") + r""" SELECT sha, CAST(count(DISTINCT path || ' ' || scope) AS BIGINT) AS scope_count
 FROM (SELECT sha, path, regexp_extract(line, '^@@ [^@]*@@\s*(.*?)\s*$', 1) AS scope FROM patches WHERE starts_with(line, '@@ ')) WHERE scope <> '' GROUP BY sha""",
    "components": f"SELECT sha, CAST(count(*) AS BIGINT) AS component_count FROM ({text.ORACLES['p06_components']}) GROUP BY sha",
    "places": f"SELECT sha, CAST(count(*) AS BIGINT) AS feature_area_count FROM ({text.ORACLES['p07_feature_areas']}) GROUP BY sha",
    "entities": f"SELECT sha, CAST(count(*) AS BIGINT) AS entity_count, {', '.join(_count(f'''kind = '{kind}' ''', f'{kind}_count') for kind in W.ENTITY_KINDS)} FROM ({text.ORACLES['p08_path_entities']}) GROUP BY sha",
    "unmapped": f"SELECT sha, n AS unmapped_path_count FROM ({text.ORACLES['p06_unmapped_paths']})",
    "subjects": text.PARSED + " SELECT sha, CAST(length(subject) AS BIGINT) AS subject_length FROM parsed",
    "bodies": f"SELECT sha, body_length FROM ({text.ORACLES['f06_clean_body']})",
    "tags": f"SELECT sha, CASE WHEN tags = '' THEN 0 ELSE CAST(len(string_split(tags, '|')) AS BIGINT) END AS subject_tag_count FROM ({text.ORACLES['f02_subject_tags']})",
    "prs": f"SELECT sha, suffix IS NOT NULL AS has_pr_number FROM ({text.ORACLES['f03_pr_numbers']})",
    "sections": f"SELECT sha, why IS NOT NULL AS has_why, false AS has_how, verify IS NOT NULL AS has_verify FROM ({text.ORACLES['f07_sections_whole']})",
    "pulled": f"SELECT sha, pulled AS pulled_commit_lines FROM ({text.ORACLES['f11_pulled_lines']})",
    "trailers": f"SELECT sha, co_authored_by AS co_author_count FROM ({text.ORACLES['f05_trailers']})",
}


def _filled(name: str) -> str:
    if name == "file_days_since_last_change":
        return name
    kind, nothing = ("BOOLEAN", "false") if name in W.FLAGS else ("DOUBLE", "0") if name in W.REALS else ("BIGINT", "0")
    return f"CAST(coalesce({name}, {nothing}) AS {kind}) AS {name}"


PLAIN = ", ".join(_filled(name) for name in W.INTRINSIC if name not in W.DERIVED)
INTRINSIC_SQL = f"""SELECT *, churn - blank_line_count - whitespace_only_line_count - comment_line_count AS logic_churn,
 churn > 0 AND churn = blank_line_count + whitespace_only_line_count + comment_line_count AND binary_file_count = 0 AND submodule_file_count = 0 AS is_comment_or_whitespace_only
 FROM (SELECT o_orderkey AS sha, {PLAIN} FROM orders o {' '.join(f'LEFT JOIN ({part}) {name} ON {name}.sha = o.o_orderkey' for name, part in PARTS.items())})"""


@query("a07_intrinsic_columns", INTRINSIC_SQL)
def _(spark, d):
    return intrinsic(spark, d, view(spark, d, "commit_base"))


PAST = ("w03_author_prior", "w04_author_area_experience", "w05_recent_experience", "w07_file_history", "w08_area_history", "w09_area_burst")
HOT = ", ".join(
    [f"""CAST(coalesce(c.l, []).list_contains('{name}') AS INT) AS "component__{name}" """ for name in COMPONENTS]
    + [f"""CAST(coalesce(b.l, []).list_contains('{name}') AS INT) AS "area__{name}" """ for name in BRANDS])
TABLE_SQL = f"""SELECT f.sha, f.idx, f.landed, s.split, coalesce(t.change_type, 'chore') AS change_type,
 {", ".join(f'''coalesce(list_contains(string_split(t.change_types, ','), '{kind}'), false) AS "type__{kind}" ''' for kind in I.PRECEDENCE)},
 strftime(make_timestamp(f.committed_epoch * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS committed_at, f.is_merge, coalesce(p.is_bot, false) AS author_is_bot,
 {", ".join(f"i.{name}" for name in W.INTRINSIC)}, {", ".join(_filled(name) for name in W.HISTORY)}, {HOT},
 {", ".join(f"a.{name} AS label_{name}" for name in L.LABELS)},
 CASE WHEN a.reverted THEN l.revert_lead_days END AS label_revert_lead_days, CASE WHEN a.bug_introducing THEN l.fix_lead_days END AS label_fix_lead_days
 FROM ({cte("facts")} SELECT * FROM facts) f JOIN ({history.ORACLES["m01_time_split"]}) s ON s.sha = f.sha JOIN ({INTRINSIC_SQL}) i ON i.sha = f.sha
 LEFT JOIN ({text.ORACLES["p01_change_types"]}) t ON t.sha = f.sha LEFT JOIN ({text.ORACLES["p11_bot_predicate"]}) p ON p.sha = f.sha
 LEFT JOIN (SELECT sha, list(component) AS l FROM ({text.ORACLES["p06_components"]}) GROUP BY sha) c ON c.sha = f.sha
 LEFT JOIN ({cte("areas")} SELECT sha, list(area) AS l FROM areas GROUP BY sha) b ON b.sha = f.sha
 LEFT JOIN ({history.ORACLES["m02_split_labels"]}) a ON a.sha = f.sha LEFT JOIN ({history.ORACLES["j04_commit_labels"]}) l ON l.sha = f.sha
 {' '.join(f'LEFT JOIN ({history.ORACLES[name]}) {name} ON {name}.sha = f.sha' for name in PAST)}"""


@query("s03_feature_table", TABLE_SQL)
def _(spark, d):
    return wide_table(spark, d)
