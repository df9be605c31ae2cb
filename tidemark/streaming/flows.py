"""Streams: incremental landing, polling with overlap, scoring once, late outcomes, running history, bursts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ancestry import ancestors_of, chains, is_ancestor, reachability
from ..operators.ledger import fresh_rows, upsert
from ..session import checkpointed


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str | None = None, per_batch: int | None = None) -> DataFrame:
    """A file source. The checkpoint of the query that reads it is the cursor: each file is taken once."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(path)


def land(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is new to a table and stop; rates are then batch jobs over the whole table."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _versions(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """All parts of a table written by batches before ``below``, with the batch number in ``v``; None if there are none."""
    from pyspark.errors import AnalysisException

    try:
        parts = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return parts if below is None else parts.filter(F.col("v") < below)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]) -> StreamingQuery:
    """Fold overlapping polls into a table in which the latest version of a key wins.

    A batch writes only its own rows, as its own part; a batch that is run again after a failure rewrites
    that part and no other. Readers merge the parts with ``current``.
    """
    def write(batch: DataFrame, number: int) -> None:
        upsert(batch.limit(0), batch, keys, order).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The latest version of every key over all parts: by ``order`` where given, so that back-filled parts replace nothing newer, then by part."""
    parts = spark.read.parquet(path)
    row = F.struct(*[F.col(name) for name in parts.columns if name != "v"])
    return parts.groupBy(*keys).agg(F.max_by(row, F.struct(*order, "v")).alias("_row")).select("_row.*")


def walk_history(spark: SparkSession, path: str, parents: DataFrame, commits: DataFrame, tip: int | str, mine: Callable[[DataFrame], DataFrame]) -> str:
    """Bring the mined table at ``path`` up to ``tip``: ``fresh``, ``forward`` (only what is new is mined) or ``rewritten`` (all is mined again).

    ``mine`` turns commits (sha) into rows. Where the last tip is no ancestor of the new one, history was rewritten and a new generation of the
    table is mined whole. Every walk writes its own part first and its entry in the list of walks last, in one small file: readers see a walk
    whole or not at all, and a walk that failed before its entry is written again from the same state.
    """
    past = walks(spark, path)
    last = None if past is None else past.orderBy(F.desc("walk")).first()
    number, generation, kind = 0, 0, "rewritten"
    wanted = spark.createDataFrame([(tip,)], commits.select("sha").schema)
    if last is not None:
        number, generation = last["walk"] + 1, last["generation"]
        if last["tip"] == str(tip):
            return "fresh"
    placed = checkpointed(chains(parents, commits))
    index = reachability(parents, placed)
    new = ancestors_of(wanted, placed, index).select("sha")
    if last is not None:
        old = spark.createDataFrame([(last["tip"],)], "sha string").select(F.col("sha").cast(commits.schema["sha"].dataType))
        pair = old.withColumnRenamed("sha", "ancestor").withColumn("of", F.lit(tip))
        if is_ancestor(pair, placed, index).first()["is_ancestor"]:
            kind = "forward"
            new = new.join(ancestors_of(old, placed, index).select("sha"), "sha", "left_anti")
        else:
            generation += 1
    mine(new).write.mode("overwrite").parquet(f"{path}/rows/generation={generation}/walk={number}")
    spark.createDataFrame([(number, generation, str(tip), kind)], "walk bigint, generation bigint, tip string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/walks/n={number}")
    return kind


def walks(spark: SparkSession, path: str) -> DataFrame | None:
    """(walk, generation, tip, kind) of the walks that were finished; None before the first."""
    entries = _versions(spark, f"{path}/walks")
    return None if entries is None else entries.drop("n")


def mined(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the table's newest generation, of finished walks only."""
    done = walks(spark, path)
    newest = done.agg(F.max("generation").alias("generation"))
    live = done.join(newest, "generation").select("generation", "walk")
    return spark.read.parquet(f"{path}/rows").join(live, ["generation", "walk"], "left_semi").drop("generation", "walk")


def drop_repeats(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """First version of a key wins; state is kept for the overlap only."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def score_once(heads: DataFrame, score: Callable[[DataFrame], DataFrame], ledger: str, checkpoint: str, keys: Sequence[str],
               order: Sequence[str], at_most: int | None = None) -> StreamingQuery:
    """Score each head that is not in the ledger yet and append it, at most ``at_most`` per batch.

    Each batch owns one part of the ledger and rewrites only that, so a repeated batch appends nothing twice.
    Heads over the limit stay out of the ledger and come with the next poll.
    """
    def write(batch: DataFrame, number: int) -> None:
        past = _versions(batch.sparkSession, ledger, below=number)
        fresh = fresh_rows(batch.limit(0) if past is None else past, batch, order, keys)
        if at_most is not None:
            fresh = fresh.orderBy(*order).limit(at_most)
        score(fresh).write.mode("overwrite").parquet(f"{ledger}/v={number}")

    return heads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.parquet(ledger).drop("v")


def late_outcomes(scores: DataFrame, outcomes: DataFrame, wait: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Scores with the outcomes that arrive within ``wait``; a score without one comes out when its time is up.

    ``scores(pr, scored_at, ..)``, ``outcomes(pr, finish, ..)``, both with event times. The batch form
    regrades everything at once.
    """
    left = scores.withWatermark("scored_at", late)
    right = outcomes.withColumnRenamed("pr", "outcome_pr").withWatermark("finish", late)
    within = F.expr(f"pr = outcome_pr AND finish >= scored_at AND finish <= scored_at + INTERVAL {wait}")
    return left.join(right, within, "leftOuter").drop("outcome_pr")


def running_count(stream: DataFrame, key: str, order: str) -> DataFrame:
    """Earlier rows of the same key, kept as state from batch to batch.

    Rows of a key must arrive in order; the batch windows give the same values on such input.
    """
    schema = f"{key} bigint, {order} bigint, prior bigint"

    def step(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(batches)[[order]].sort_values(order)
        rows[key] = name[0]
        rows["prior"] = range(seen, seen + len(rows))
        state.update((seen + len(rows),))
        yield rows[[key, order, "prior"]]

    return stream.groupBy(key).applyInPandasWithState(step, schema, "seen bigint", "append", "NoTimeout")


def replace(totals: DataFrame, path: str, cursor: str):
    """Run a stream of totals to the end of its source; every batch replaces the table, so a repeated one changes nothing."""
    def write(frame: DataFrame, _batch: int) -> None:
        frame.write.mode("overwrite").parquet(path)

    return totals.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", cursor).trigger(availableNow=True).start()


def weekly_burst(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Rows per key and sliding week, updated daily; rows later than ``late`` are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "7 days", "1 day"), key).agg(F.count(F.lit(1)).alias("n"))
