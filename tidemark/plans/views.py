"""Input tables of the registered queries, derived from the given Parquet tables.

Each view is one SQL text that both engines can run; ``{DAY}`` stands for the day number of an
order, which the two engines spell differently. The landing position is the exception: Spark
assigns it with a distributed sort, the oracle with ``row_number``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import dense_index
from ..session import checkpointed

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

SPARK_DAY = "datediff(o_orderdate, DATE'1970-01-01')"
DUCK_DAY = "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))"
SPARK_EPOCH = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
DUCK_EPOCH = "CAST(floor(epoch(ts)) AS BIGINT)"

COMMIT_COLUMNS = """o_orderkey AS sha, o_custkey AS author_id, o_orderkey AS pr_number, CAST({DAY} AS BIGINT) AS day,
    {DAY} * CAST(86400 AS BIGINT) - CASE WHEN o_orderkey % 7 = 0 THEN 432000 ELSE 0 END AS committed_epoch,
    o_orderkey % 29 = 0 AS is_revert,
    CASE WHEN o_orderkey % 29 = 0 AND o_orderkey % 2 = 0 THEN o_orderkey - 1 - (o_orderkey % 97) END AS reverts_sha,
    CASE WHEN o_orderkey % 29 = 0 AND o_orderkey % 3 <> 0 THEN o_orderkey - 1 - (o_orderkey % 53) END AS reverts_pr,
    o_orderpriority = '1-URGENT' AS fix_like, o_orderkey % 41 = 0 AS is_merge,
    o_orderkey % 37 = 0 AS submodule_only, o_orderkey % 5 <> 0 AS szz_eligible"""

SQL = {
    "commit_base": f"SELECT {COMMIT_COLUMNS} FROM orders",
    "changes": """SELECT l_orderkey AS sha, concat('p/', l_partkey % 40, '/', l_partkey) AS path,
        CASE l_returnflag WHEN 'A' THEN 'A' ELSE 'M' END AS status,
        CAST(l_quantity AS BIGINT) AS additions, CAST(l_discount * 100 AS BIGINT) AS deletions,
        l_partkey % 50 = 0 AS is_binary FROM lineitem""",
    "areas": "SELECT DISTINCT l_orderkey AS sha, p_brand AS area FROM lineitem JOIN part ON l_partkey = p_partkey",
    "churn": """SELECT l_orderkey AS sha, CAST(sum(l_quantity) AS BIGINT) AS churn FROM lineitem GROUP BY l_orderkey""",
    "line_origin": """SELECT sha AS parent, path, line, (sha * 7 + line * 13) % 16001 AS origin_sha,
        CASE line % 5 WHEN 0 THEN '};' WHEN 1 THEN '// note' WHEN 2 THEN '#' WHEN 3 THEN '  x = 1'
             ELSE '  call(x)' END AS text FROM line_grid""",
    "targets": """SELECT l_orderkey AS sha, concat('p/', l_partkey % 40, '/', l_partkey) AS path,
        CAST(min(l_linenumber) AS BIGINT) AS range_start,
        CAST(min(l_linenumber) + max(CAST(l_quantity AS BIGINT)) % 6 AS BIGINT) AS range_end
        FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "job_results": """SELECT user_id AS pr, event_type AS job, event_id AS build, {EPOCH} AS finish,
        CASE WHEN value > 200 THEN 'failed' WHEN value < 1 THEN NULL WHEN value < 6 THEN 'canceled'
             ELSE 'succeeded' END AS result FROM events""",
    "scored": """SELECT l.doc_id AS row_id, CAST(l.toxic AS BIGINT) AS y, CAST(d.n_chars % 50 AS DOUBLE) / 50 AS score,
        d.n_chars AS effort, d.source AS model FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "messages": """SELECT doc_id AS sha, concat(
        CASE WHEN doc_id % 11 = 0 THEN concat('Revert "', CASE WHEN doc_id % 22 = 0 THEN 'Revert "' ELSE '' END)
             WHEN doc_id % 11 = 1 THEN 'Revert PR #17 ' ELSE '' END,
        CASE doc_id % 6 WHEN 0 THEN '[CI] [ci] ' WHEN 1 THEN '[Build] ' WHEN 2 THEN 'src/net: ' ELSE '' END,
        CASE doc_id % 9 WHEN 0 THEN 'Fix crash in ' WHEN 1 THEN 'Add support for ' WHEN 2 THEN 'Bump version to 1.2.3 '
             WHEN 3 THEN 'dependabot: update ' WHEN 4 THEN 'Add new platform ' ELSE '' END,
        replace(substr(text, 1, 40), chr(10), ' '),
        CASE WHEN doc_id % 4 <> 0 THEN concat(' (#', doc_id + 100, ')') ELSE '' END,
        CASE WHEN doc_id % 11 = 0 THEN concat(CASE WHEN doc_id % 22 = 0 THEN '"' ELSE '' END, '" (#', doc_id, ')') ELSE '' END,
        chr(10), chr(10),
        CASE doc_id % 3 WHEN 0 THEN concat('#### Why I did it', chr(10)) ELSE '' END,
        CASE WHEN doc_id % 8 = 0 THEN '<!-- template -->' ELSE '' END, text, chr(10), chr(10), chr(10), chr(10),
        CASE WHEN doc_id % 3 = 0 THEN concat('#### How to verify it?', chr(10), 'run ', doc_id, chr(10)) ELSE '' END,
        CASE WHEN doc_id % 10 = 3 THEN concat('Fixes #', doc_id, chr(10)) ELSE '' END,
        CASE WHEN doc_id % 11 < 2 THEN concat('This reverts commit 0123abc', doc_id + 1000, '.', chr(10)) ELSE '' END,
        CASE WHEN doc_id % 13 = 0 THEN concat('reverts org/repo#', doc_id, chr(10)) ELSE '' END,
        CASE WHEN doc_id % 7 = 0 THEN concat('* 35fb54fd - [core]: Validate', chr(10)) ELSE '' END,
        'Signed-off-by: A <a@x.org>', chr(10),
        CASE WHEN doc_id % 2 = 0 THEN concat('Co-authored-by: B <b@x.org>', chr(10), 'cc: c', chr(10)) ELSE '' END
        ) AS message, concat('Dev', doc_id % 9, CASE WHEN doc_id % 17 = 0 THEN ' [bot]' ELSE '' END) AS author_name,
        concat(' User', doc_id % 9, '@X.org ') AS author_email FROM documents""",
    "page_paths": """SELECT page_id, url, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path
        FROM pages""",
}

PATCH_PATH = """CASE doc_id % 6 WHEN 0 THEN 'a/x.py' WHEN 1 THEN 'b/x.c' WHEN 2 THEN 'README.md' WHEN 3 THEN 'notes.txt'
        WHEN 4 THEN 'conf/x.c.j2' ELSE 'src/Makefile' END"""
# One patch text per document; the oracle builds its lines directly.
SPARK_PATCHES = f"""SELECT doc_id AS sha, {PATCH_PATH} AS path, array_join(transform(l, (x, i) -> CASE i % 9 WHEN 0 THEN concat('@@ -', i + 1, ',3 +', i + 2, ' @@ fn') WHEN 1 THEN concat('-', x)
            WHEN 2 THEN concat('-# ', x) WHEN 3 THEN '-' WHEN 4 THEN concat('+ ', replace(l[i - 3], ' ', '  '), ' ') WHEN 5 THEN concat('+# ', x)
            WHEN 6 THEN '+' WHEN 7 THEN concat(' ', x) ELSE concat('+', x) END), chr(10)) AS patch
    FROM (SELECT doc_id, split(text, chr(10)) AS l FROM documents)"""
DUCK_PATCHES = f"""SELECT doc_id AS sha, {PATCH_PATH} AS path, i - 1 AS pos, CASE (i - 1) % 9 WHEN 0 THEN concat('@@ -', (i - 1) + 1, ',3 +', (i - 1) + 2, ' @@ fn') WHEN 1 THEN concat('-', l[i])
            WHEN 2 THEN concat('-# ', l[i]) WHEN 3 THEN '-' WHEN 4 THEN concat('+ ', replace(l[i - 3], ' ', '  '), ' ') WHEN 5 THEN concat('+# ', l[i])
            WHEN 6 THEN '+' WHEN 7 THEN concat(' ', l[i]) ELSE concat('+', l[i]) END AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)"""

NEEDS = {"line_origin": ("line_grid",)}

SPARK_GRID = """SELECT sha, path, CAST(line AS BIGINT) AS line FROM
    (SELECT DISTINCT l_orderkey AS sha, concat('p/', l_partkey % 40, '/', l_partkey) AS path FROM lineitem)
    LATERAL VIEW explode(sequence(1, 14)) g AS line"""
DUCK_GRID = """SELECT sha, path, CAST(line AS BIGINT) AS line FROM
    (SELECT DISTINCT l_orderkey AS sha, concat('p/', l_partkey % 40, '/', l_partkey) AS path FROM lineitem),
    unnest(range(1, 15)) AS g(line)"""

DUCK_COMMITS = f"""SELECT *, CAST(row_number() OVER (ORDER BY day, sha) - 1 AS BIGINT) AS idx
    FROM (SELECT {COMMIT_COLUMNS} FROM orders)"""
DUCK_FACTS = """SELECT *, CAST(max(committed_epoch) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS landed
    FROM commits"""

# Oracle views that build on other views, in the order they must appear.
DUCK_ORDER = ("commits", "facts")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame; only the tables its text names are read."""
    text = {"line_grid": SPARK_GRID, "patches": SPARK_PATCHES}.get(name) or SQL[name]
    text = text.replace("{DAY}", SPARK_DAY).replace("{EPOCH}", SPARK_EPOCH)
    frames = {}
    for source in (*NEEDS.get(name, ()), *TABLES):
        if source in NEEDS.get(name, ()):
            frames[source] = view(spark, sf_dir, source)
        elif source in text.replace("(", " ").replace(")", " ").split():
            frames[source] = table(spark, sf_dir, source)
    text = text.replace("{", "{{").replace("}", "}}")
    for source in frames:
        text = _named(text, source)
    return spark.sql(text, **frames)


def view_of(spark: SparkSession, sf_dir: str, name: str, wanted: DataFrame) -> DataFrame:
    """A view over ``lineitem`` for the commits ``wanted(sha)`` only: lines of other commits leave before any are grouped or exploded."""
    files = table(spark, sf_dir, "lineitem").join(wanted.select(F.col("sha").alias("l_orderkey")).distinct(), "l_orderkey", "left_semi")
    frames = {"lineitem": files}
    if NEEDS.get(name) == ("line_grid",):
        frames = {"line_grid": spark.sql(_named(SPARK_GRID, "lineitem"), lineitem=files)}
    text = SQL[name].replace("{", "{{").replace("}", "}}")
    return spark.sql(_named(text, *frames), **frames)


def _named(text: str, source: str) -> str:
    for word in ("FROM", "JOIN"):
        text = text.replace(f"{word} {source}", f"{word} {{{source}}}")
    return text


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits with their landing position."""
    return dense_index(view(spark, sf_dir, "commit_base"), ["day", "sha"])


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits with landing position and landing time, written once: most queries read them several times."""
    from ..operators.history import landing_time

    return checkpointed(landing_time(commits(spark, sf_dir)))


def with_areas(spark: SparkSession, sf_dir: str, frame: DataFrame, *columns: str) -> DataFrame:
    """(columns.., area) of commits that touch at least one area."""
    return view(spark, sf_dir, "areas").join(frame.select("sha", *columns), "sha").select("sha", *columns, "area")


def cte(*names: str) -> str:
    """``WITH`` clause of the oracle for the named views."""
    wanted: list[str] = []
    for name in names:
        if name in ("commits", "facts"):
            wanted += [item for item in DUCK_ORDER[: DUCK_ORDER.index(name) + 1] if item not in wanted]
        else:
            wanted += [item for item in (*NEEDS.get(name, ()), name) if item not in wanted]
    texts = {"commits": DUCK_COMMITS, "facts": DUCK_FACTS, "line_grid": DUCK_GRID, "patches": DUCK_PATCHES}
    parts = [f"{name} AS ({texts.get(name) or SQL[name]})".replace("{DAY}", DUCK_DAY).replace("{EPOCH}", DUCK_EPOCH)
             for name in wanted]
    return "WITH " + ",\n".join(parts)


def epoch_column(name: str):
    return F.unix_seconds(F.col(name).cast("timestamp"))
