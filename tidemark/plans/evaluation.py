"""Registered queries: metrics, thresholds, intervals, ledger appends, outcomes and grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as G
from ..operators import metrics as M
from .registering import Collector
from .views import cte, table, view

query = Collector()
QUERIES, ORACLES = query.queries, query.oracles

RANKING = """ cells AS (SELECT {k} AS g, score, sum(y * {w}) AS tp, sum({w}) AS n FROM {t} GROUP BY {k}, score),
 runs AS (SELECT *, sum(tp) OVER (PARTITION BY g ORDER BY score DESC) AS ctp, sum(n) OVER (PARTITION BY g ORDER BY score DESC) AS cn,
   sum(tp) OVER (PARTITION BY g) AS p, sum(n) OVER (PARTITION BY g) AS total FROM cells),
 ranked AS (SELECT g, CAST(any_value(total) AS BIGINT) AS n, CAST(any_value(p) AS BIGINT) AS positives,
   sum(tp * (ctp / CAST(cn AS DOUBLE))) / nullif(CAST(any_value(p) AS DOUBLE), 0) AS ap,
   (sum(tp * (total - cn + (n + 1) / CAST(2 AS DOUBLE))) - any_value(p) * (any_value(p) + 1) / CAST(2 AS DOUBLE))
     / nullif(CAST(any_value(p) * (any_value(total) - any_value(p)) AS DOUBLE), 0) AS auc FROM runs GROUP BY g)"""


def ranking_sql(source, key="'all'", weight="1"):
    return RANKING.format(t=source, k=key, w=weight)


def rows(spark, d):
    return view(spark, d, "scored")


@query("a14_average_precision", cte("scored") + "," + ranking_sql("scored") + " SELECT round(ap, 6) AS value FROM ranked")
def _(spark, d):
    return M.average_precision(rows(spark, d))


@query("a14_a15_ranking_per_group", cte("scored") + "," + ranking_sql("scored", "model") + """
 SELECT g AS model, n, positives, round(ap, 6) AS pr_auc, round(auc, 6) AS roc_auc FROM ranked""")
def _(spark, d):
    return M.ranking(rows(spark, d), ["model"])


@query("a15_roc_auc", cte("scored") + "," + ranking_sql("scored") + " SELECT round(auc, 6) AS value FROM ranked")
def _(spark, d):
    return M.roc_auc(rows(spark, d))


@query("a16_recall_at_effort", cte("scored") + """, spent AS (SELECT *, sum(effort) OVER (PARTITION BY model ORDER BY score DESC, row_id) AS s,
  sum(effort) OVER (PARTITION BY model) AS e, sum(y) OVER (PARTITION BY model) AS p FROM scored)
 SELECT model, round(coalesce(sum(y) FILTER (s <= CAST(0.2 AS DOUBLE) * e), 0) / nullif(CAST(any_value(p) AS DOUBLE), 0), 6) AS value
 FROM spent GROUP BY model""")
def _(spark, d):
    return M.recall_at_effort(rows(spark, d), ["model"])


@query("a17_brier", cte("scored") + " SELECT model, round(avg(pow(score - y, 2)), 6) AS value FROM scored GROUP BY model")
def _(spark, d):
    return M.brier(rows(spark, d), ["model"])


@query("e03_metric_registry", cte("scored") + "," + ranking_sql("scored") + """, spent AS (SELECT *, sum(effort) OVER (ORDER BY score DESC, row_id) AS s,
  sum(effort) OVER () AS e, sum(y) OVER () AS p FROM scored)
 SELECT 'pr_auc' AS metric, round(ap, 6) AS value FROM ranked UNION ALL SELECT 'roc_auc', round(auc, 6) FROM ranked
 UNION ALL SELECT 'brier', round(avg(pow(score - y, 2)), 6) FROM scored
 UNION ALL SELECT 'recall_at_20pct_effort', round(sum(y) FILTER (s <= CAST(0.2 AS DOUBLE) * e) / CAST(any_value(p) AS DOUBLE), 6) FROM spent""")
def _(spark, d):
    from functools import reduce

    frames = [metric(rows(spark, d), ()).select(F.lit(name).alias("metric"), "value") for name, metric in M.METRICS.items()]
    return reduce(lambda left, right: left.unionByName(right), frames)


WILSON = """ CASE WHEN n > 0 THEN round(greatest(0.0::DOUBLE, (k / CAST(n AS DOUBLE) + 3.8416::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt(k / CAST(n AS DOUBLE) * (1 - k / CAST(n AS DOUBLE)) / n
  + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)), 4) END AS {p}_low,
 CASE WHEN n > 0 THEN round(least(1.0::DOUBLE, (k / CAST(n AS DOUBLE) + 3.8416::DOUBLE / (2 * n) + 1.96::DOUBLE * sqrt(k / CAST(n AS DOUBLE) * (1 - k / CAST(n AS DOUBLE)) / n
  + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)), 4) END AS {p}_high"""


@query("a13_wilson_rates", f"""SELECT source, k AS bad_k, n AS bad_n, round(k / nullif(CAST(n AS DOUBLE), 0), 4) AS bad_rate, {WILSON.format(p='bad')}
 FROM (SELECT d.source, CAST(count(*) FILTER (l.quality = 0) AS BIGINT) AS k, CAST(count(l.doc_id) AS BIGINT) AS n
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND d.source <> 'src3' GROUP BY d.source)""")
def _(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels")
    joined = docs.join(labels, "doc_id", "left").withColumn("quality", F.when(F.col("source") != "src3", F.col("quality")))
    counts = joined.groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("k"), F.count("quality").alias("n"))
    return counts.select("source", *M.rate(F.col("k"), F.col("n"), "bad"))


def bootstrap_sql(source, by_cell=False):
    parts = ", ".join(f"('0x' || substr(h, {8 * at + 1}, 8))::BIGINT AS u{at}" for at in range(4))
    draws = f""" atoms AS (SELECT y, score, count(*) AS c, min(row_id) AS tie FROM {source} GROUP BY y, score),
 draws AS (SELECT b, y, score, c, {parts} FROM (SELECT *, md5(concat('7:', b, ':', tie)) AS h FROM atoms, range(0, 1000) AS r(b))),
 drawn AS (SELECT b, y, score, w FROM (SELECT b, y, score, {M.poisson_weight("c", ["u0", "u1", "u2", "u3"])} AS w FROM draws) WHERE w > 0),""" if by_cell else f"""
 draws AS (SELECT b, y, score, ('0x' || substr(md5(concat('7:', b, ':', row_id)), 1, 8))::BIGINT AS u FROM {source}, range(0, 1000) AS r(b)),
 drawn AS (SELECT b, y, score, w FROM (SELECT b, y, score, {M.poisson_count("u")} AS w FROM draws) WHERE w > 0),"""
    return draws + ranking_sql("drawn", "b", "w") + """,
 vals AS (SELECT 'pr_auc' AS metric, round(ap, 12) AS value FROM ranked UNION ALL SELECT 'roc_auc', round(auc, 12) FROM ranked
   UNION ALL SELECT 'brier', sum(w * pow(score - y, 2)) / sum(w) FROM drawn GROUP BY b)
 SELECT metric, CAST(count(value) AS BIGINT) AS samples, round(quantile_cont(value, 0.025), 6) AS ci_low,
  round(quantile_cont(value, 0.975), 6) AS ci_high FROM vals GROUP BY metric"""


@query("a18_bootstrap_intervals", cte("scored") + "," + bootstrap_sql("scored"))
def _(spark, d):
    return M.bootstrap(rows(spark, d), seed=7)


# Scores to two digits: many rows in a cell, as after calibration.
@query("a18_bootstrap_few_scores", cte("scored") + ", coarse AS (SELECT row_id, y, round(score, 2) AS score FROM scored)," + bootstrap_sql("coarse", by_cell=True))
def _(spark, d):
    return M.bootstrap(rows(spark, d).withColumn("score", F.round("score", 2)), seed=7, by_cell=True)


PRED = "CASE WHEN score >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END"


@query("a19_confusion", cte("scored") + f"""SELECT model, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
 coalesce(round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 4), 0) AS precision, coalesce(round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 4), 0) AS recall FROM (
 SELECT model, count(*) FILTER (p = 1 AND y = 1) AS tp, count(*) FILTER (p = 1 AND y = 0) AS fp, count(*) FILTER (p = 0 AND y = 1) AS fn
 FROM (SELECT *, {PRED} AS p FROM scored) GROUP BY model)""")
def _(spark, d):
    return M.confusion(rows(spark, d).withColumn("pred", F.expr("CASE WHEN score >= 0.5D THEN 1 ELSE 0 END")), ["model"])


@query("a20_threshold_search", cte("scored").replace("WITH", "WITH RECURSIVE", 1) + """, grid AS (SELECT i, (5 * i) / CAST(100 AS DOUBLE) AS t FROM range(1, 20) AS r(i)),
 counts AS (SELECT model, i, t, count(*) FILTER (score >= t AND y = 1) AS tp, count(*) FILTER (score >= t AND y = 0) AS fp,
   count(*) FILTER (score < t AND y = 1) AS fn FROM scored, grid GROUP BY ALL),
 prf AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS p, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS r FROM counts),
 f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM prf),
 walk(model, i, t, f1, p, r) AS (SELECT DISTINCT model, 0::BIGINT, 0.5::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM scored
  UNION ALL SELECT w.model, f.i, CASE WHEN f.f1 >= w.f1 THEN f.t ELSE w.t END, CASE WHEN f.f1 >= w.f1 THEN round(f.f1, 4) ELSE w.f1 END,
   CASE WHEN f.f1 >= w.f1 THEN round(f.p, 4) ELSE w.p END, CASE WHEN f.f1 >= w.f1 THEN round(f.r, 4) ELSE w.r END
   FROM walk w JOIN f ON f.model = w.model AND f.i = w.i + 1)
 SELECT model, t AS threshold, f1, p AS precision, r AS recall FROM walk WHERE i = 19""")
def _(spark, d):
    return M.pick_threshold(rows(spark, d), ["model"])


@query("j30_percentile_lookup", cte("scored") + """ SELECT s.row_id, round(100 * (SELECT count(*) FROM scored r WHERE r.score <= s.score AND r.row_id % 2 = 0)
  / CAST((SELECT count(*) FROM scored WHERE row_id % 2 = 0) AS DOUBLE), 2) AS percentile FROM scored s""")
def _(spark, d):
    s = rows(spark, d).select("row_id", F.col("score").alias("p"))
    return M.percentile_of(s, s.filter("row_id % 2 = 0")).select("row_id", "percentile")


LEDGER_ROWS = """SELECT CAST(user_id * 1000 + event_id % 40 AS BIGINT) AS subject, concat('m', event_id % 3) AS model, event_id AS seq,
 round(value, 2) AS p FROM events"""


@query("s15_keyed_append", f"""WITH batch AS ({LEDGER_ROWS}), old AS (SELECT DISTINCT subject, model FROM batch WHERE seq % 5 = 0)
 SELECT subject, model, min(seq) AS seq, arg_min(p, seq) AS p FROM batch b WHERE NOT EXISTS
 (SELECT 1 FROM old o WHERE o.subject = b.subject AND o.model = b.model) GROUP BY subject, model""")
def _(spark, d):
    batch = spark.sql(LEDGER_ROWS.replace("FROM events", "FROM {events}"), events=table(spark, d, "events"))
    return G.fresh_rows(batch.filter("seq % 5 = 0"), batch, ["seq"], ["subject", "model"])


@query("u03_keyed_upsert", f"""WITH batch AS ({LEDGER_ROWS}) SELECT subject, model, arg_max(seq, (isnew, seq)) AS seq, arg_max(p, (isnew, seq)) AS p FROM
 (SELECT *, CASE WHEN seq % 4 = 0 THEN 1 ELSE 0 END AS isnew FROM batch) GROUP BY subject, model""")
def _(spark, d):
    batch = spark.sql(LEDGER_ROWS.replace("FROM events", "FROM {events}"), events=table(spark, d, "events"))
    return G.upsert(batch.filter("seq % 4 <> 0"), batch.filter("seq % 4 = 0"), ["subject", "model"], ["seq"])


OUTCOME_CTES = """ scores AS (SELECT build AS subject, concat('m', build % 3) AS model, pr, finish - (build % 50) * 1000 AS scored_at,
   (build % 97) / CAST(97 AS DOUBLE) AS p, job FROM job_results),
 hits AS (SELECT s.*, b.build, b.job AS bjob, b.result FROM scores s LEFT JOIN LATERAL
   (SELECT * FROM job_results b WHERE b.pr = s.pr AND b.finish >= s.scored_at ORDER BY b.finish, b.build LIMIT 1) b ON true),
 graded AS (SELECT *, CASE WHEN result = 'failed' THEN 1 WHEN result = 'succeeded' THEN 0 END AS y FROM hits)"""


def scores_and_builds(spark, d):
    r = view(spark, d, "job_results")
    s = r.select(F.col("build").alias("subject"), F.expr("concat('m', build % 3)").alias("model"), "pr",
                 F.expr("finish - (build % 50) * 1000").alias("scored_at"), F.expr("(build % 97) / 97D").alias("p"), "job")
    labels = F.when(F.col("result").isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map("job", "result"))
    return s, r.select("pr", "build", "finish", labels.alias("labels"))


@query("j15_forward_asof_outcome", cte("job_results") + "," + OUTCOME_CTES + """ SELECT subject, CASE WHEN y IS NOT NULL THEN build END AS build, CAST(y AS BIGINT) AS y FROM graded""")
def _(spark, d):
    return G.outcomes_after(*scores_and_builds(spark, d)).select("subject", "build", "y")


def graded_ledger(spark, d):
    s, builds = scores_and_builds(spark, d)
    out = G.outcomes_after(s, builds)
    return out.select("model", "p", "y", "labels", F.create_map("job", F.expr("(subject % 89) / 89D")).alias("score_by_job"))


@query("a21_ledger_scorecard", cte("job_results") + "," + OUTCOME_CTES + ", unit AS (SELECT model, y, p AS score FROM graded WHERE y IS NOT NULL),"
       + ranking_sql("unit", "model") + """ SELECT c.model, c.rows, c.pending, r.n, r.positives, round(r.ap, 6) AS pr_auc, round(r.auc, 6) AS roc_auc
 FROM (SELECT model, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (y IS NULL) AS BIGINT) AS pending FROM graded GROUP BY model) c
 LEFT JOIN ranked r ON r.g = c.model""")
def _(spark, d):
    return G.grade(graded_ledger(spark, d))[0]


@query("a21_ledger_job_grain", cte("job_results") + "," + OUTCOME_CTES + """, unit AS (SELECT model, y, (subject % 89) / CAST(89 AS DOUBLE) AS score
  FROM graded WHERE y IS NOT NULL AND job = bjob),""" + ranking_sql("unit", "model")
       + " SELECT g AS model, n, positives, round(ap, 6) AS pr_auc, round(auc, 6) AS roc_auc FROM ranked")
def _(spark, d):
    return G.grade(graded_ledger(spark, d))[1]


@query("a11_upper_median", """SELECT l_returnflag AS flag, v AS median FROM (SELECT l_returnflag, l_shipdate, CAST(l_extendedprice AS BIGINT) AS v,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY CAST(l_extendedprice AS BIGINT)) - 1 AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
 WHERE rn = n // 2""")
def _(spark, d):
    prices = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.round("l_extendedprice").cast("bigint").alias("v"))
    return M.upper_median(prices, "v", ["flag"])
