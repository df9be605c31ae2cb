"""Registered queries: streams replayed over the given tables, compared with the batch result where it is exact."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators.prefix import dense_index
from ..session import checkpoint_dir, checkpointed
from ..streaming import flows
from .registering import Collector
from .views import DUCK_EPOCH, SPARK_EPOCH, cte, facts, table

query = Collector()
QUERIES, ORACLES = query.queries, query.oracles


def scratch(spark):
    """A new folder under the shared checkpoint folder for the sink and the cursor of one run."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/table", f"{base}/cursor"


def stream(spark, d, name):
    return flows.read_stream(spark, d, table(spark, d, name).schema, glob=f"{name}.parquet")


def landing(spark, frame, order, parts):
    """The frame as files that a stream takes one by one, in the order of their numbers."""
    path = f"{checkpoint_dir(spark)}/landing-{uuid.uuid4().hex}"
    for number in range(parts):
        frame.filter(F.col(order) == number).drop(order).coalesce(1).write.mode("append").parquet(path)
    return path


@query("x01_incremental_landing", """SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (value > 200) AS BIGINT) AS failed FROM events GROUP BY event_type""")
def _(spark, d):
    path, cursor = scratch(spark)
    for _run in range(2):
        # The second run finds no new file and adds nothing.
        flows.land(stream(spark, d, "events"), path, cursor).awaitTermination()
    landed = spark.read.parquet(path)
    return landed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 200).alias("failed"))


# Commits in a line by landing position. First up to six tenths, then on to the last odd one below eight tenths; then the odd ones after seven tenths are rewritten away.
CUTS = "(SELECT count(*) AS n FROM facts)"


@query("x01_changed_tip", cte("facts") + f""" SELECT CASE WHEN f.idx % 2 = 0 THEN 'even' ELSE 'odd' END AS half, CAST(count(*) AS BIGINT) AS commits, CAST(sum(f.sha) AS BIGINT) AS keys, 'rewritten' AS last_walk, 3::BIGINT AS walks
 FROM facts f, {CUTS} WHERE f.idx % 2 = 0 OR f.idx <= n * 7 // 10 OR f.idx > n * 8 // 10 GROUP BY 1""")
def _(spark, d):
    f = facts(spark, d).select("sha", "idx")
    n = f.count()
    path, _cursor = scratch(spark)
    gone = (F.col("idx") % 2 == 1) & (F.col("idx") > n * 7 // 10) & (F.col("idx") <= n * 8 // 10)
    states = [f.filter(F.col("idx") <= n * 6 // 10), f.filter(F.col("idx") <= (n * 8 // 10 - 1) // 2 * 2 + 1), f.filter(~gone)]
    for now in states:
        placed = checkpointed(dense_index(now, ["idx"], out="nth"))
        parents = placed.join(placed.select((F.col("nth") + 1).alias("nth"), F.col("sha").alias("parent")), "nth").select("sha", "parent", F.lit(0).alias("ord"))
        tip = now.agg(F.max_by("sha", "idx")).first()[0]
        flows.walk_history(spark, path, checkpointed(parents), now, tip, lambda new: new.join(f, "sha"))
    walks = flows.walks(spark, path)
    last = walks.agg(F.max_by("kind", "walk").alias("last_walk"), F.count(F.lit(1)).alias("walks")).first()
    rows = flows.mined(spark, path).groupBy(F.when(F.col("idx") % 2 == 0, "even").otherwise("odd").alias("half")).agg(F.count(F.lit(1)).alias("commits"), F.sum("sha").alias("keys"))
    return rows.withColumn("last_walk", F.lit(last.last_walk)).withColumn("walks", F.lit(last.walks))


POLLS = """SELECT user_id * 10 + event_id % 7 AS id, event_id AS seq, round(value, 2) AS value FROM events"""


@query("x02_polling_upsert", f"""SELECT id, max(seq) AS seq, arg_max(value, seq) AS value FROM ({POLLS}) GROUP BY id""")
def _(spark, d):
    polls = spark.sql(POLLS.replace("FROM events", "FROM {events}"), events=table(spark, d, "events"))
    cut = polls.agg(F.expr("max(seq) / 2")).scalar()
    # Two polls that overlap by a tenth of the events.
    twice = polls.withColumn("_cut", cut).withColumn("poll", F.explode(F.expr(
        "filter(array(CASE WHEN seq <= _cut * 1.1 THEN 0 END, CASE WHEN seq >= _cut * 0.9 THEN 1 END), x -> x is not null)"))).drop("_cut")
    source = landing(spark, twice, "poll", 2)
    path, cursor = scratch(spark)
    run = flows.upsert_stream(flows.read_stream(spark, source, polls.schema, per_batch=1), path, cursor, ["id"], ["seq"])
    run.awaitTermination()
    return flows.current(spark, path, ["id"])


@query("x02_back_fill", f"""SELECT id, max(seq) AS seq, arg_max(value, seq) AS value FROM ({POLLS}) GROUP BY id""")
def _(spark, d):
    polls = spark.sql(POLLS.replace("FROM events", "FROM {events}"), events=table(spark, d, "events"))
    end = polls.agg(F.max("seq")).first()[0] + 1
    path, cursor = scratch(spark)
    source = f"{checkpoint_dir(spark)}/landing-{uuid.uuid4().hex}"
    ledger = spark.createDataFrame([], "start bigint, end bigint")
    # The poller starts in the middle, is down for a while, and then fills up what is behind it, at most half of all at a time.
    for number, now in enumerate((end // 2, end * 9 // 10, end, end)):
        if number < 2:
            wanted = spark.createDataFrame([(now - end // 10, now)], "start bigint, end bigint")
        else:
            wanted = I.next_fetches(ledger, now, 0, end // 20, cap=end // 2).select("start", "end")
        asked = [tuple(row) for row in wanted.collect()]
        inside = F.lit(False)
        for low, high in asked:
            inside = inside | ((F.col("seq") >= low) & (F.col("seq") < high))
        polls.filter(inside).write.mode("append").parquet(source)
        flows.upsert_stream(flows.read_stream(spark, source, polls.schema), path, cursor, ["id"], ["seq"]).awaitTermination()
        ledger = checkpointed(I.united(ledger.unionByName(spark.createDataFrame(asked, "start bigint, end bigint"))))
    return flows.current(spark, path, ["id"], ["seq"])


SPANS = """SELECT user_id, CAST(floor({EPOCH} / 600) AS BIGINT) AS start, CAST(floor({EPOCH} / 600) AS BIGINT) + CAST(floor(value) AS BIGINT) AS "end" FROM events"""
UNITED = f"""WITH s AS ({SPANS.replace("{EPOCH}", DUCK_EPOCH)}), r AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE start < "end"),
 n AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < start THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end") AS island FROM r),
 united AS (SELECT user_id, min(start) AS start, max("end") AS "end" FROM n GROUP BY user_id, island)"""


def spans(spark, d):
    return spark.sql(SPANS.replace("{EPOCH}", SPARK_EPOCH).replace('"end"', "`end`").replace("FROM events", "FROM {events}"), events=table(spark, d, "events"))


@query("x02_fetched_intervals", UNITED + ' SELECT user_id, start, "end" FROM united')
def _(spark, d):
    return I.united(spans(spark, d), ["user_id"])


@query("x02_open_intervals", UNITED + """, b AS (SELECT user_id, min(start) - 5 AS low, max("end") + 7 AS high FROM united GROUP BY user_id),
 e AS (SELECT user_id, start, "end" FROM united UNION ALL SELECT user_id, low - 1, low FROM b UNION ALL SELECT user_id, high, high + 1 FROM b),
 g AS (SELECT user_id, "end" AS start, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS "end" FROM e) SELECT user_id, start, "end" FROM g WHERE start < "end" AND "end" IS NOT NULL""")
def _(spark, d):
    rows = checkpointed(spans(spark, d))
    bounds = rows.filter("start < end").groupBy("user_id").agg((F.min("start") - 5).alias("start"), (F.max("end") + 7).alias("end"))
    return I.open_between(rows, bounds, ["user_id"])


@query("x02_drop_repeats", "SELECT DISTINCT event_id FROM events")
def _(spark, d):
    path, cursor = scratch(spark)
    once = stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    flows.land(flows.drop_repeats(once, "event_id", "ts").select("event_id"), path, cursor).awaitTermination()
    return spark.read.parquet(path)


@query("x03_score_heads_once", """SELECT l_orderkey AS pr, CAST(count(*) AS BIGINT) AS n_files, round(max(p_retailprice) / 3000, 6) AS p FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""")
def _(spark, d):
    prices = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    files = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")

    def score(heads):
        joined = heads.select("pr").join(files, F.col("pr") == F.col("l_orderkey")).join(prices, "l_partkey")
        return joined.groupBy("pr").agg(F.count(F.lit(1)).alias("n_files"), F.round(F.max("p_retailprice") / 3000, 6).alias("p"))

    heads = stream(spark, d, "orders").select(F.col("o_orderkey").alias("pr"), F.concat(F.lit("h"), "o_orderkey").alias("head"))
    path, cursor = scratch(spark)
    flows.score_once(heads, score, path, cursor, ["pr"], ["pr"]).awaitTermination()
    return flows.read_ledger(spark, path)


@query("x04_late_outcomes", cte("job_results") + """ SELECT s.build, b.build AS outcome, b.result FROM job_results s JOIN job_results b ON b.pr = s.pr AND b.finish >= s.finish + 3600 AND b.finish <= s.finish + 3600 + 7200""")
def _(spark, d):
    events = stream(spark, d, "events").withColumn("ts", F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp"))))
    scores = events.select(F.col("user_id").alias("pr"), F.col("event_id").alias("build"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("scored_at"))
    result = F.expr("CASE WHEN value > 200 THEN 'failed' WHEN value < 1 THEN NULL WHEN value < 6 THEN 'canceled' ELSE 'succeeded' END")
    outcomes = events.select(F.col("user_id").alias("pr"), F.col("event_id").alias("outcome"), F.col("ts").alias("finish"), result.alias("result"))
    path, cursor = scratch(spark)
    joined = flows.late_outcomes(scores, outcomes, wait="2 hours")
    flows.land(joined.filter("outcome is not null").select("build", "outcome", "result"), path, cursor).awaitTermination()
    return spark.read.parquet(path)


@query("x04_late_outcomes_outer", cte("job_results") + """ SELECT s.build, b.build AS outcome, b.result FROM job_results s LEFT JOIN job_results b ON b.pr = s.pr AND b.finish >= s.finish + 3600 AND b.finish <= s.finish + 3600 + 7200""")
def _(spark, d):
    source = f"{checkpoint_dir(spark)}/landing-{uuid.uuid4().hex}"
    given = table(spark, d, "events")
    # One more record, of a change of its own and a day after all others, moves both watermarks past every score's time.
    values = {"ts": F.max("ts") + F.expr("INTERVAL 1 DAY"), "user_id": F.min("user_id") - 1}
    last = given.agg(*[values.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name) for field in given.schema])
    given.unionByName(last).write.parquet(source)
    events = flows.read_stream(spark, source, given.schema).withColumn("ts", F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp"))))
    scores = events.select(F.col("user_id").alias("pr"), F.col("event_id").alias("build"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("scored_at"))
    result = F.expr("CASE WHEN value > 200 THEN 'failed' WHEN value < 1 THEN NULL WHEN value < 6 THEN 'canceled' ELSE 'succeeded' END")
    outcomes = events.select(F.col("user_id").alias("pr"), F.col("event_id").alias("outcome"), F.col("ts").alias("finish"), result.alias("result"))
    path, cursor = scratch(spark)
    flows.land(flows.late_outcomes(scores, outcomes, wait="2 hours").select("build", "outcome", "result"), path, cursor).awaitTermination()
    return spark.read.parquet(path).filter("build is not null")


@query("x05_running_history", cte("job_results") + """ SELECT pr, build, CAST(row_number() OVER (PARTITION BY pr ORDER BY build) - 1 AS BIGINT) AS prior FROM job_results""")
def _(spark, d):
    path, cursor = scratch(spark)
    rows = stream(spark, d, "events").select(F.col("user_id").alias("pr"), F.col("event_id").alias("build"))
    flows.land(flows.running_count(rows, "pr", "build"), path, cursor).awaitTermination()
    return spark.read.parquet(path)


@query("x06_weekly_burst", """SELECT event_type, CAST(epoch(w) AS BIGINT) AS week_start, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type, unnest(range(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS w FROM events) GROUP BY ALL""")
def _(spark, d):
    path, cursor = scratch(spark)
    events = stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    flows.replace(flows.weekly_burst(events, "event_type", "ts"), path, cursor).awaitTermination()
    return spark.read.parquet(path).select("event_type", F.unix_seconds("window.start").alias("week_start"), "n")


@query("s17_feed_stream", """SELECT o_orderkey AS number, concat('h', o_custkey) AS head_sha, o_orderstatus AS title FROM orders""")
def _(spark, d):
    source = f"{checkpoint_dir(spark)}/feed-{uuid.uuid4().hex}"
    table(spark, d, "orders").selectExpr("o_orderkey AS number", "concat('h', o_custkey) AS head_sha", "o_orderstatus AS title").write.json(source)
    path, cursor = scratch(spark)
    feed = flows.read_stream(spark, source, "number bigint, head_sha string, title string", fmt="json")
    flows.land(feed, path, cursor).awaitTermination()
    return spark.read.parquet(path)
