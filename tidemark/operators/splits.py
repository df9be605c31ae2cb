"""Time splits with gaps, chronological entity splits, and exclusion lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history import DAY
from .prefix import dense_index, running

# Fixed values.
FRACTIONS = (0.70, 0.15, 0.15)
GAP_DAYS = 90
SPLITS = ("train", "validation", "test")
MIN_PREFIX = 7


def resolve_prefixes(keys: DataFrame, key: str, prefixes: DataFrame, min_length: int = MIN_PREFIX) -> DataFrame:
    """Each prefix with the number of keys it starts and, if that is one, the key. Prefixes under ``min_length`` are ``too_short``: they resolve to nothing, with 0 matches.

    No pairwise ``startswith`` is needed and either side may be large: see ``prefix_pairs``.
    """
    wanted = prefixes.select("prefix", F.length("prefix").alias("_n")).distinct()
    usable = wanted.filter(F.col("_n") >= min_length)
    found = prefix_pairs(keys.select(F.col(key).cast("string").alias("_key")), "_key", usable).groupBy("prefix").agg(
        F.count(F.lit(1)).alias("matches"), F.min("_key").alias("_only")
    )
    return wanted.join(found, "prefix", "left").select(
        "prefix", F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches"),
        F.when(F.col("matches") == 1, F.col("_only")).alias("key"), (F.col("_n") < min_length).alias("too_short"),
    )


def prefix_pairs(keys: DataFrame, key: str, prefixes: DataFrame) -> DataFrame:
    """``keys`` with each ``prefix`` of ``prefixes`` that its column ``key`` starts with.

    Keys are shuffled once, cut to the shortest length in use. Those that meet a prefix there are then cut to each length that
    prefixes with this head have, and joined by equality; all others are done.
    """
    wanted = prefixes.select("prefix", F.length("prefix").alias("_n")).distinct()
    shortest = wanted.agg(F.min("_n")).scalar()
    heads = wanted.withColumn("_head", F.left("prefix", shortest)).groupBy("_head").agg(F.collect_set("_n").alias("_lengths"))
    met = keys.withColumn("_head", F.left(key, shortest)).join(heads, "_head")
    cut = met.select(*keys.columns, F.explode("_lengths").alias("_n")).filter(F.length(key) >= F.col("_n")).withColumn("prefix", F.left(key, F.col("_n")))
    return cut.join(wanted.select("prefix"), "prefix").select(*keys.columns, "prefix")


def boundaries(
    facts: DataFrame, held: DataFrame | None = None, fractions: Sequence[float] = FRACTIONS, gap_days: int = GAP_DAYS
) -> DataFrame:
    """One row: validation_start, test_start and snapshot, as landing times.

    A boundary is the landing time of the eligible row at floor(n * f). Eligible rows are counted along
    the landing order block by block; only the three numbers of the answer come together in one row.
    """
    snapshot = facts.agg(F.max("landed"))
    gap = gap_days * DAY
    open_rows = facts if held is None else facts.join(held.select("sha").distinct(), "sha", "left_anti")
    eligible = open_rows.filter(F.col("landed") <= snapshot.scalar() - gap).select("idx", "landed")
    ranked = running(eligible, [], "idx", {"_rank": F.lit(1)})
    count = eligible.agg(F.count(F.lit(1))).scalar()
    first = F.floor(F.col("_count") * F.lit(fractions[0])).cast("bigint")
    second = F.floor(F.col("_count") * F.lit(fractions[0] + fractions[1])).cast("bigint")
    picked = ranked.withColumn("_count", count).agg(
        F.max(F.when(F.col("_rank") == first, F.col("landed"))).alias("_v"),
        F.max(F.when(F.col("_rank") == second, F.col("landed"))).alias("_t"),
    )
    end = snapshot.scalar()
    return picked.select(
        F.coalesce("_v", end).alias("validation_start"), F.coalesce("_t", end).alias("test_start"), end.alias("snapshot")
    )


def assign_splits(
    facts: DataFrame, held: DataFrame | None = None, fractions: Sequence[float] = FRACTIONS, gap_days: int = GAP_DAYS
) -> tuple[DataFrame, DataFrame]:
    """(rows with ``split``, ends per split). Rows just before a boundary or the snapshot go to ``gap``."""
    limits = boundaries(facts, held, fractions, gap_days)
    gap = gap_days * DAY
    snapshot, validation, test = (limits.select(name).scalar() for name in ("snapshot", "validation_start", "test_start"))
    marked = facts
    if held is not None:
        marked = facts.join(held.select("sha").distinct().withColumn("_held", F.lit(True)), "sha", "left")
    else:
        marked = facts.withColumn("_held", F.lit(None).cast("boolean"))
    landed = F.col("landed")
    split = (
        F.when(F.col("_held"), "holdout")
        .when(landed > snapshot - gap, "gap")
        .when(landed < validation, F.when(landed <= validation - gap, "train").otherwise("gap"))
        .when(landed < test, F.when(landed <= test - gap, "validation").otherwise("gap"))
        .otherwise("test")
    )
    ends = limits.select(F.explode(F.array(
        F.struct(F.lit("train").alias("split"), F.col("validation_start").alias("end")),
        F.struct(F.lit("validation").alias("split"), F.col("test_start").alias("end")),
        F.struct(F.lit("test").alias("split"), F.col("snapshot").alias("end")),
    )).alias("e")).select("e.split", "e.end")
    return marked.withColumn("split", split).drop("_held"), ends


def entity_split(entities: DataFrame, key: str, when: str, fractions: Sequence[float] = (0.70, 0.15)) -> DataFrame:
    """Split whole entities by their last time: floor(0.70 n) train, floor(0.15 n) valid, rest test.

    Undated entities are train. All rows of an entity stay together.
    """
    dated = dense_index(entities.filter(F.col(when).isNotNull()), [when, key], out="_rank")
    count = entities.filter(F.col(when).isNotNull()).agg(F.count(F.lit(1))).scalar()
    train = F.floor(count * F.lit(fractions[0]))
    valid = train + F.floor(count * F.lit(fractions[1]))
    placed = dated.withColumn(
        "split", F.when(F.col("_rank") < train, "train").when(F.col("_rank") < valid, "valid").otherwise("test")
    ).drop("_rank")
    return placed.unionByName(entities.filter(F.col(when).isNull()).withColumn("split", F.lit("train")))
