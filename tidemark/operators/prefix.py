"""Distributed running totals.

A window over one key, or over the whole table, puts all rows of that key in one task. The
functions here cut the order axis into blocks instead: totals per block are combined before the
shuffle, the few block totals are accumulated per key, and the rows of one (key, block) cell are
accumulated on their own. One hot key therefore spreads over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

# Positions per cell. A cell holds at most this many rows, because callers pass one row per
# (key, position); a table of 10^12 positions has 10^6 cells per key.
BLOCK = 1 << 20


def dense_index(
    df: DataFrame, order: Sequence[Column | str], out: str = "idx", keys: Sequence[str] = ()
) -> DataFrame:
    """Position 0..n-1 of every row in the total order ``order``, restarting for each key.

    The sort is range-partitioned, so it has no single-task step; the sorted rows are
    checkpointed once so that partition numbers and offsets stay the same on any retry.
    """
    columns = df.columns
    ordered = checkpointed(df.orderBy(*[F.col(key) for key in keys], *order))
    serial = F.monotonically_increasing_id()
    tagged = ordered.select(
        "*",
        F.shiftright(serial, 33).alias("_part"),
        serial.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"),
    )
    # One row per partition, so the ordered sum over all of them is tiny and always broadcastable.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    placed = tagged.join(F.broadcast(starts), "_part").withColumn(
        out, (F.col("_start") + F.col("_at")).cast("bigint")
    )
    if keys:
        first = placed.groupBy(*keys).agg(F.min(out).alias("_first"))
        placed = placed.join(first, list(keys)).withColumn(out, F.col(out) - F.col("_first"))
    return placed.select(*columns, out)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    *,
    inclusive: bool = False,
    width: int = BLOCK,
) -> DataFrame:
    """Add running sums and maxima along the integer column ``order`` within ``keys``.

    ``(keys, order)`` must be unique; aggregate to one row per position first. Exclusive totals
    (the default) see positions strictly below a row, inclusive ones the row as well. Sums are 0
    and maxima null where nothing came before.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    columns = [name for name in df.columns if name not in sums and name not in maxes]
    cell = [*keys, "_block"]
    staged = df.withColumn("_block", F.floor(F.col(order) / F.lit(width)).cast("bigint"))
    for name, value in {**sums, **maxes}.items():
        staged = staged.withColumn(f"_v_{name}", value)

    totals = staged.groupBy(*cell).agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums],
        *[F.max(f"_v_{name}").alias(f"_t_{name}") for name in maxes],
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *cell,
        *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_c_{name}") for name in sums],
        *[F.max(f"_t_{name}").over(earlier).alias(f"_c_{name}") for name in maxes],
    )
    inside = Window.partitionBy(*cell).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1
    )
    return staged.join(carried, cell).select(
        *columns,
        *[(F.col(f"_c_{name}") + F.coalesce(F.sum(f"_v_{name}").over(inside), F.lit(0))).alias(name)
          for name in sums],
        *[F.greatest(f"_c_{name}", F.max(f"_v_{name}").over(inside)).alias(name) for name in maxes],
    )


def running_in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    sums: Mapping[str, Column],
    *,
    inclusive: bool = True,
    width: int = BLOCK,
) -> DataFrame:
    """Running sums along any total order, by way of a dense position (kept as ``_pos``)."""
    placed = dense_index(df, order, out="_pos", keys=keys)
    return running(placed, keys, "_pos", sums, inclusive=inclusive, width=width)


def counts_at(
    events: DataFrame, probes: DataFrame, keys: Sequence[str], at: str, *, width: int = BLOCK
) -> DataFrame:
    """How many events of a key happened at or before each probe time (integers, same units).

    Both sides shrink to one row per (key, time) before they meet, so a hot key costs at most one
    row per tick of its clock. Returns (keys, at, n) for every distinct probe.
    """
    ticks = (
        events.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("n")).withColumn("_probe", F.lit(False))
        .unionByName(probes.select(*keys, at).distinct().withColumn("n", F.lit(0).cast("bigint"))
                     .withColumn("_probe", F.lit(True)))
        .groupBy(*keys, at).agg(F.sum("n").alias("n"), F.bool_or("_probe").alias("_probe"))
    )
    return (
        running(ticks, keys, at, {"n": F.col("n")}, inclusive=True, width=width)
        .filter("_probe").select(*keys, at, F.col("n").cast("bigint").alias("n"))
    )
