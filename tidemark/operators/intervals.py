"""Intervals [start, end) of integers per key: their union, what it leaves open, and what to fetch next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import BLOCK, running


def united(intervals: DataFrame, keys: Sequence[str] = (), width: int = BLOCK) -> DataFrame:
    """(keys, start, end): the union of ``intervals(keys, start, end)`` as disjoint intervals that do not touch; empty ones are none.

    A union begins where no earlier interval reaches: a running maximum of ends, then a running count of beginnings, both in blocks of ``width``
    units of the axis, so one key with very many intervals is not one task.
    """
    longest = intervals.filter("start < end").groupBy(*keys, "start").agg(F.max("end").alias("end"))
    reached = running(longest, keys, "start", maxes={"reach": F.col("end")}, width=width)
    begun = reached.withColumn("new", F.when(F.col("reach").isNull() | (F.col("reach") < F.col("start")), 1).otherwise(0))
    numbered = running(begun.drop("reach"), keys, "start", {"island": F.col("new")}, inclusive=True, width=width)
    return numbered.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def open_between(intervals: DataFrame, bounds: DataFrame, keys: Sequence[str] = (), width: int = BLOCK) -> DataFrame:
    """(keys, start, end) of all of ``bounds(keys, start, end)`` that ``intervals`` leave open. One bound per key; a key without intervals is open whole."""
    limits = bounds.select(*keys, F.col("start").alias("_low"), F.col("end").alias("_high"))
    on = list(keys) or F.lit(True)
    inside = intervals.join(F.broadcast(limits) if not keys else limits, on).select(
        *keys, F.greatest("start", "_low").alias("start"), F.least("end", "_high").alias("end"))
    # Bounds of no length keep the first and last gap: a closed stretch of one unit before and one at the end.
    edges = limits.select(*keys, F.explode(F.array(
        F.struct((F.col("_low") - 1).alias("start"), F.col("_low").alias("end")), F.struct(F.col("_high").alias("start"), (F.col("_high") + 1).alias("end")))).alias("e")).select(*keys, "e.*")
    held = united(inside.unionByName(edges), keys, width)
    # The next stretch starts where the gap ends: the smallest start among the later ones, as the largest of negatives from the other side.
    mirrored = held.withColumn("at", -F.col("start"))
    following = running(mirrored, keys, "at", maxes={"next": -F.col("start")}, width=width)
    return following.filter("next is not null").select(*keys, F.col("end").alias("start"), (-F.col("next")).alias("end"))


def next_fetches(fetched: DataFrame, now: int, start: int, overlap: int, cap: int | None = None) -> DataFrame:
    """(start, end, why) of the next poll: from ``overlap`` before the newest fetched point to ``now``, and older holes back to ``start``.

    ``fetched(start, end)`` is the ledger of what was fetched. With ``cap`` at most so many units of holes are filled, newest first; the hole that
    crosses the bound is cut there, so that repeated polls fill everything in the end.
    """
    newest = fetched.agg(F.coalesce(F.max("end"), F.lit(start)).alias("newest"))
    latest = newest.select(F.greatest(F.col("newest") - overlap, F.lit(start)).cast("bigint").alias("start"), F.lit(now).cast("bigint").alias("end"), F.lit("poll").alias("why"))
    bound = newest.select(F.lit(start).cast("bigint").alias("start"), F.col("newest").cast("bigint").alias("end")).filter("start < end")
    holes = open_between(fetched, bound)
    if cap is not None:
        before = Window.orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
        # Holes between polls are as few as missed polls.
        room = cap - F.coalesce(F.sum(F.col("end") - F.col("start")).over(before), F.lit(0))
        holes = holes.withColumn("room", room).filter("room > 0").select(F.greatest(F.col("start"), F.col("end") - F.col("room")).alias("start"), "end")
    return latest.unionByName(holes.withColumn("why", F.lit("hole")))
