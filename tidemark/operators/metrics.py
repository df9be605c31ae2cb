"""Evaluation metrics over (group, y, score) rows, exact under tied scores and any partitioning."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running_in_order

# Fixed values.
EFFORT_SHARE = 0.2
Z95 = 1.96
THRESHOLDS = tuple(step / 100 for step in range(5, 96, 5))


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Ungrouped input gets one constant key, so that grouped and ungrouped share their plans."""
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])


def ranking(df: DataFrame, keys: Sequence[str] = (), weight: Column | None = None, digits: int = 6) -> DataFrame:
    """n, positives, PR-AUC and ROC-AUC per group; tied scores share one threshold.

    Rows collapse to one per distinct score before anything is ordered. Average precision adds
    recall step times precision at each score; ROC-AUC gives tied scores their mean rank.
    """
    df, by = _keyed(df, keys)
    w = F.lit(1) if weight is None else weight
    cells = df.groupBy(*by, "score").agg(F.sum(F.col("y") * w).alias("_tp"), F.sum(w).alias("_n"))
    ranked = running_in_order(
        cells, by, [F.desc("score")], {"_ctp": F.col("_tp"), "_cn": F.col("_n")}
    )
    totals = cells.groupBy(*by).agg(F.sum("_tp").alias("positives"), F.sum("_n").alias("n"))
    rank = F.col("n") - F.col("_cn") + (F.col("_n") + 1) / 2
    sums = ranked.join(totals, by).groupBy(*by, "n", "positives").agg(
        F.sum(F.col("_tp") * (F.col("_ctp") / F.col("_cn"))).alias("_ap"),
        F.sum(F.col("_tp") * rank).alias("_ranks"),
    )
    p, q = F.col("positives"), F.col("n") - F.col("positives")
    return sums.select(
        *keys, F.col("n").cast("bigint").alias("n"), p.cast("bigint").alias("positives"),
        F.round(F.try_divide("_ap", p), digits).alias("pr_auc"),
        F.round(F.try_divide(F.col("_ranks") - p * (p + 1) / 2, p * q), digits).alias("roc_auc"),
    )


def average_precision(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return ranking(df, keys).select(*keys, F.col("pr_auc").alias("value"))


def roc_auc(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return ranking(df, keys).select(*keys, F.col("roc_auc").alias("value"))


def recall_at_effort(
    df: DataFrame, keys: Sequence[str] = (), tie: str = "row_id", share: float = EFFORT_SHARE
) -> DataFrame:
    """Share of positives found, riskiest first, before ``share`` of all effort is spent."""
    df, by = _keyed(df, keys)
    spent = running_in_order(df, by, [F.desc("score"), F.asc(tie)], {"_spent": F.col("effort")})
    totals = df.groupBy(*by).agg(F.sum("effort").alias("_all_effort"), F.sum("y").alias("_p"))
    found = spent.join(totals, by).groupBy(*by, "_p").agg(
        F.sum(F.when(F.col("_spent") <= F.lit(share) * F.col("_all_effort"), F.col("y")).otherwise(0)).alias("_f")
    )
    return found.select(*keys, F.round(F.try_divide("_f", "_p"), 6).alias("value"))


def brier(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.avg(F.pow(F.col("score") - F.col("y"), F.lit(2.0))), 6).alias("value"))


# Name to builder; each takes (rows with y, score, effort and row_id; group columns).
METRICS: dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]] = {
    "pr_auc": average_precision,
    "roc_auc": roc_auc,
    "recall_at_20pct_effort": recall_at_effort,
    "brier": brier,
}


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Both ends of the Wilson score interval, clipped to [0, 1]; null for no trials."""
    p = F.try_divide(successes, total)
    scale = 1 + F.try_divide(F.lit(z * z), total)
    centre = p + F.try_divide(F.lit(z * z), 2 * total)
    half = z * F.sqrt(F.try_divide(p * (1 - p), total) + F.try_divide(F.lit(z * z), 4 * total * total))
    low, high = (centre - half) / scale, (centre + half) / scale
    some = total > 0
    return (
        F.when(some, F.round(F.greatest(F.lit(0.0), low), 4)), F.when(some, F.round(F.least(F.lit(1.0), high), 4))
    )


def rate(successes: Column, total: Column, prefix: str) -> list[Column]:
    low, high = wilson(successes, total)
    return [
        successes.cast("bigint").alias(f"{prefix}_k"), total.cast("bigint").alias(f"{prefix}_n"),
        F.round(F.try_divide(successes, total), 4).alias(f"{prefix}_rate"),
        low.alias(f"{prefix}_low"), high.alias(f"{prefix}_high"),
    ]


def _f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(tp, tp + fp), zero)
    recall = F.coalesce(F.try_divide(tp, tp + fn), zero)
    return precision, recall, F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero)


def confusion(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, precision and recall of 0/1 predictions; 0 where undefined."""
    counts = df.groupBy(*keys).agg(
        F.count_if((F.col("pred") == 1) & (F.col("y") == 1)).alias("tp"),
        F.count_if((F.col("pred") == 1) & (F.col("y") == 0)).alias("fp"),
        F.count_if((F.col("pred") == 0) & (F.col("y") == 1)).alias("fn"),
    )
    precision, recall, _ = _f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(
        *keys, "tp", "fp", "fn", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall")
    )


def pick_threshold(df: DataFrame, keys: Sequence[str] = (), grid: Sequence[float] = THRESHOLDS) -> DataFrame:
    """The grid threshold with the best F1; a later threshold wins against the best one rounded to 4 places.

    Rows are counted by how many grid points they reach; running totals over those few cells give the counts at
    every threshold, which are folded in order.
    """
    df, by = _keyed(df, keys)
    steps = sorted(float(step) for step in grid)
    # How many grid points lie at or below the score; a null score counts nowhere.
    reached = F.when(F.col("score").isNotNull(), sum((F.col("score") >= step).cast("int") for step in steps))
    cells = df.withColumn("_reached", reached).groupBy(*by, "_reached").agg(
        F.count_if(F.col("y") == 1).alias("_ones"), F.count_if(F.col("y") == 0).alias("_zeros"))
    tried = cells.select("*", F.posexplode(F.array(*[F.lit(step) for step in steps])).alias("_at", "t"))
    hit, none = F.col("_reached") > F.col("_at"), F.lit(0)
    counts = tried.groupBy(*by, "t").agg(
        F.sum(F.when(hit, F.col("_ones")).otherwise(none)).alias("tp"), F.sum(F.when(hit, F.col("_zeros")).otherwise(none)).alias("fp"),
        F.sum(F.when(~hit, F.col("_ones")).otherwise(none)).alias("fn"),
    )
    precision, recall, f1 = _f1(F.col("tp"), F.col("fp"), F.col("fn"))
    steps = counts.select(*by, F.struct(F.col("t"), f1.alias("f1"), precision.alias("p"), recall.alias("r")).alias("s"))
    folded = steps.groupBy(*by).agg(F.array_sort(F.collect_list("s")).alias("steps")).withColumn(
        "best",
        F.aggregate(
            "steps",
            F.struct(F.lit(0.5).alias("t"), F.lit(0.0).alias("f1"), F.lit(None).cast("double").alias("p"),
                     F.lit(None).cast("double").alias("r")),
            lambda best, step: F.when(
                step["f1"] >= best["f1"],
                F.struct(step["t"].alias("t"), F.round(step["f1"], 4).alias("f1"), F.round(step["p"], 4).alias("p"),
                         F.round(step["r"], 4).alias("r")),
            ).otherwise(best),
        ),
    )
    return folded.select(
        *keys, F.col("best.t").alias("threshold"), "best.f1", F.col("best.p").alias("precision"),
        F.col("best.r").alias("recall"),
    )


def poisson_count(draw: str, mean: int = 1) -> str:
    """SQL for a Poisson count from a uniform 32-bit number, by inversion; both engines can run it."""
    bounds, total, term, count = [], 0.0, math.exp(-mean), 0
    while count <= mean or term * 2**32 >= 0.5:
        total += term
        bounds.append(f"WHEN {draw} < {round(total * 2**32)} THEN {count}")
        count += 1
        term *= mean / count
    return f"CASE {' '.join(bounds)} ELSE {count} END"


# Cells of fewer rows are drawn exactly; the powers of two below it have one table each.
EXACT_DRAWS = 16


def poisson_weight(size: str, draws: Sequence[str]) -> str:
    """SQL for a Poisson(``size``) count from four uniform 32-bit numbers; both engines can run it.

    Below ``EXACT_DRAWS`` the sum of exact counts for the powers of two that make up ``size``, so the work is constant.
    From there on a normal quantile with its correction for skew (Cornish-Fisher), whose error in probability is below one percent at
    16 and falls with ``size``.
    """
    exact = " + ".join(f"CASE WHEN floor({size} / {2**k}) % 2 = 1 THEN {poisson_count(draw, 2**k)} ELSE 0 END" for k, draw in enumerate(draws))
    z = f"(sqrt(-2 * ln(({draws[0]} + 1) / CAST(4294967297 AS DOUBLE))) * cos({draws[1]} * CAST({2 * math.pi / 2**32!r} AS DOUBLE)))"
    large = f"greatest(0, floor({size} + sqrt({size}) * {z} + ({z} * {z} - 1) / 6 + 0.5))"
    return f"CAST(CASE WHEN {size} < {EXACT_DRAWS} THEN {exact} ELSE {large} END AS BIGINT)"


def bootstrap(df: DataFrame, samples: int = 1000, seed: int = 0, tie: str = "row_id", by_cell: bool = False) -> DataFrame:
    """Percentile intervals of the ranking metrics and the Brier score over resampled rows.

    Each sample takes each row Poisson(1) times, drawn from a hash of seed, sample and ``tie``; this stands for drawing n of n rows
    with replacement and needs neither an order nor a join. Rows add up to one weight per sample, score and outcome before anything is
    shuffled. With ``by_cell`` each (sample, distinct score, outcome) draws once instead, Poisson with its rows as the mean, from the smallest
    ``tie`` of the cell: other draws of the same distribution, rounded from ``EXACT_DRAWS`` rows on. Rows without a score or an outcome take no part.
    """
    known = df.filter("score is not null and y is not null")
    cells = known.groupBy("y", "score").agg(F.count(F.lit(1)).alias("_c"), F.min(tie).alias("_tie")) if by_cell else known.select("y", "score", F.col(tie).alias("_tie"))
    hashed = cells.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), "b", "_tie")))
    part = lambda at: F.conv(F.substring("_h", 8 * at + 1, 8), 16, 10).cast("bigint")
    if by_cell:
        draws = ["_u0", "_u1", "_u2", "_u3"]
        drawn = hashed.select("b", "y", "score", "_c", *[part(at).alias(name) for at, name in enumerate(draws)]).select(
            "b", "y", "score", F.expr(poisson_weight("_c", draws)).alias("_w")).filter("_w > 0")
    else:
        drawn = hashed.select("b", "y", "score", part(0).alias("_u")).select("b", "y", "score", F.expr(poisson_count("_u")).alias("_w")).filter(
            "_w > 0").groupBy("b", "y", "score").agg(F.sum("_w").alias("_w"))
    error = drawn.groupBy("b").agg(
        (F.sum(F.col("_w") * F.pow(F.col("score") - F.col("y"), F.lit(2.0))) / F.sum("_w")).alias("brier")
    )
    values = ranking(drawn, ["b"], weight=F.col("_w"), digits=12).join(error, "b")
    long = values.unpivot(["b"], ["pr_auc", "roc_auc", "brier"], "metric", "value").filter("value is not null")
    return long.groupBy("metric").agg(
        F.count(F.lit(1)).alias("samples"),
        F.round(F.percentile("value", 0.025), 6).alias("ci_low"),
        F.round(F.percentile("value", 0.975), 6).alias("ci_high"),
    )


def upper_median(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """The element at position n div 2 of the sorted values: the upper of two middle ones."""
    df, by = _keyed(df.filter(F.col(value).isNotNull()), keys)
    cells = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_in_order(cells, by, [F.asc(value)], {"_upto": F.col("_n")})
    totals = cells.groupBy(*by).agg(F.sum("_n").alias("_size"))
    middle = ranked.join(totals, by).filter(F.col("_upto") > F.floor(F.col("_size") / 2))
    return middle.groupBy(*by).agg(F.min(value).alias("median")).select(*keys, "median")


def percentile_of(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """100 x the share of reference scores at or below p, for every row of ``scores(key.., p)``.

    Distinct values of both sides are ordered once; the running count of reference rows is looked
    up by equality, so neither side is broadcast.
    """
    marks = (
        reference.groupBy(F.col("p")).agg(F.count(F.lit(1)).alias("_n"))
        .unionByName(scores.select("p").distinct().withColumn("_n", F.lit(0).cast("bigint")))
        .groupBy("p").agg(F.sum("_n").alias("_n"))
    )
    upto = running_in_order(marks, [], [F.asc("p")], {"_upto": F.col("_n")}).select("p", "_upto")
    total = reference.agg(F.count(F.lit(1))).scalar()
    return scores.join(upto, "p").withColumn(
        "percentile", F.round(100 * F.col("_upto") / total, 2)
    ).drop("_upto")
