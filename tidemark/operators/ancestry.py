"""Ancestry of commits by a reachability index: chains of first parents, and per commit the highest place it reaches on each.

A commit continues the chain of its first parent if it is that parent's smallest such child; otherwise it opens a chain. A commit that
reaches place p of a chain reaches all places below, so one row (commit, chain, highest place) stands for any number of ancestors: the
index has as many rows as commits times the chains they reach, where the closure has one per pair of commits. Both are built by doubling, in as many
rounds as the binary logarithm of the longest chain, or of the changes of chain on the longest way, each round written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .prefix import running

ROUNDS = 64


def chains(parents: DataFrame, commits: DataFrame) -> DataFrame:
    """(sha, chain, place) of every commit; a chain is named by its lowest commit, at place 0.

    ``parents(sha, parent, ord)`` with ord 0 for the first parent, ``commits(sha)``. Parents outside ``commits`` count as missing.
    """
    known = commits.select("sha").distinct()
    first = parents.filter("ord = 0").join(known, "sha", "left_semi").join(known.withColumnRenamed("sha", "parent"), "parent", "left_semi")
    chosen = first.groupBy("parent").agg(F.min("sha").alias("sha"))
    # (sha, low, steps): ``low`` lies so many steps down the chain of ``sha``; ``low`` doubles its distance each round.
    state = written(known.join(chosen, "sha", "left").select("sha", F.coalesce("parent", "sha").alias("low"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("steps")))
    for _ in range(ROUNDS):
        below = state.select(F.col("sha").alias("low"), F.col("low").alias("lower"), F.col("steps").alias("more"))
        jumped = written(state.join(below, "low").select("sha", F.col("lower").alias("low"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")))
        state = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return state.select("sha", F.col("low").alias("chain"), F.col("steps").alias("place"))
    raise RuntimeError(f"a chain is longer than 2^{ROUNDS} commits, or parents form a cycle")


def reachability(parents: DataFrame, placed: DataFrame, first_only: bool = False) -> DataFrame:
    """(sha, chain, place): the highest place of every chain that a commit reaches, its own included; a written table.

    ``placed`` is that of ``chains``. With ``first_only`` only first parents are followed. Rounds run over the few commits that leave their
    chain, its doors: a commit reaches what the highest door at or below it on its chain reaches. A round doubles the changes of chain
    that are seen; only then the other commits take over what their door reaches.
    """
    edges = parents.filter("ord = 0") if first_only else parents
    own = placed.select("sha", F.col("chain").alias("own"), F.col("place").alias("at"))
    target = placed.select(F.col("sha").alias("parent"), "chain", "place")
    direct = written(edges.join(target, "parent").join(own, "sha").filter("chain <> own").groupBy("sha", "own", "at", "chain").agg(F.max("place").alias("place")))
    here = written(direct.select("sha", "own", "at").distinct())
    # Each place that an edge leads to, with the highest door at or below it.
    probes = (
        here.select(F.col("own").alias("chain"), F.col("at").alias("place"), F.col("at").alias("_door"))
        .unionByName(direct.select("chain", "place", F.lit(None).cast("bigint").alias("_door"))).groupBy("chain", "place").agg(F.max("_door").alias("_door"))
    )
    under = running(probes, ["chain"], "place", maxes={"_at": F.col("_door")}, inclusive=True).filter("_at is not null")
    doors = written(under.join(here.select(F.col("sha").alias("_sha"), F.col("own").alias("chain"), F.col("at").alias("_at")), ["chain", "_at"]).select("chain", "place", "_sha"))
    index = _along(here, direct.select("sha", "chain", "place"))
    size = _weight(index)
    for _ in range(ROUNDS):
        onward = index.join(doors, ["chain", "place"]).select("sha", "_sha").join(index.withColumnRenamed("sha", "_sha"), "_sha").select("sha", "chain", "place")
        index = _along(here, index.unionByName(onward))
        now = _weight(index)
        if now == size:
            break
        size = now
    else:
        raise RuntimeError(f"the index is not complete after {ROUNDS} rounds")
    # Doors also reach their own chain by detours, never above themselves.
    inner = placed.select("sha", "chain", "place")
    return written(_spread(own, index.join(here, "sha").filter("chain <> own").select("sha", "own", "at", "chain", "place")).unionByName(inner))


def _along(here: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (sha, chain, place) with what lower commits of the same chain found, one row per commit and chain reached."""
    best = written(found.groupBy("sha", "chain").agg(F.max("place").alias("place")).join(here, "sha"))
    return written(_spread(here, best))


def _spread(here: DataFrame, best: DataFrame) -> DataFrame:
    """Each commit of ``here(sha, own, at)`` with the highest places that ``best(sha, own, at, chain, place)`` has at or below it on its own chain."""
    wide = here.join(best.select("own", "chain").distinct(), "own").join(best.select("sha", "chain", "place"), ["sha", "chain"], "left")
    top = running(wide.select("sha", "own", "chain", "at", "place"), ["own", "chain"], "at", maxes={"top": F.col("place")}, inclusive=True)
    return top.filter("top is not null").select("sha", "chain", F.col("top").alias("place"))


def _weight(index: DataFrame) -> tuple:
    """Places and rows only grow; when neither does, nothing changed."""
    return tuple(index.agg(F.count(F.lit(1)), F.sum(F.col("place").cast("decimal(38,0)"))).first())


def is_ancestor(pairs: DataFrame, placed: DataFrame, index: DataFrame) -> DataFrame:
    """``pairs(ancestor, of)`` with ``is_ancestor``: one lookup each; a commit is its own ancestor, an unknown one is nobody's."""
    where = placed.select(F.col("sha").alias("ancestor"), "chain", F.col("place").alias("_place"))
    top = index.select(F.col("sha").alias("of"), "chain", F.col("place").alias("_top"))
    return pairs.join(where, "ancestor", "left").join(top, ["of", "chain"], "left").select(
        *pairs.columns, F.coalesce(F.col("_place") <= F.col("_top"), F.lit(False)).alias("is_ancestor"))


def ancestor_counts(index: DataFrame) -> DataFrame:
    """(sha, n_ancestors), itself included, without naming any of them."""
    return index.groupBy("sha").agg(F.sum(F.col("place") + 1).alias("n_ancestors"))


def ancestors_of(start: DataFrame, placed: DataFrame, index: DataFrame) -> DataFrame:
    """(start, sha) of all ancestors of the commits ``start(sha)``, themselves included: every chain up to the place reached."""
    reach = index.join(start.select("sha").distinct(), "sha").select(F.col("sha").alias("start"), "chain", F.col("place").alias("_top"))
    return reach.join(placed, "chain").filter("place <= _top").select("start", "sha")


def merge_bases(pairs: DataFrame, placed: DataFrame, index: DataFrame, landed: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with ``base``, their newest common ancestor by ``landed(sha, idx)``; null where they have none.

    On each chain both reach, the lower of their places is the newest common one, so a pair has one candidate a chain.
    """
    left = index.select(F.col("sha").alias("a"), "chain", F.col("place").alias("_a"))
    right = index.select(F.col("sha").alias("b"), "chain", F.col("place").alias("_b"))
    common = pairs.select("a", "b").distinct().join(left, "a").join(right, ["b", "chain"]).select("a", "b", "chain", F.least("_a", "_b").alias("place"))
    found = common.join(placed, ["chain", "place"]).join(landed.select("sha", "idx"), "sha").groupBy("a", "b").agg(F.max_by("sha", "idx").alias("base"))
    return pairs.join(found, ["a", "b"], "left").select(*pairs.columns, "base")


def first_parent_walk(tips: DataFrame, parents: DataFrame, placed: DataFrame, times: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """(tip, sha, nth): first parents from each tip down, newest first, with ``times(sha, landed)`` inside the window given."""
    walked = ancestors_of(tips, placed, reachability(parents, placed, first_only=True)).withColumnRenamed("start", "tip").join(times.select("sha", "landed"), "sha")
    if since is not None:
        walked = walked.filter(F.col("landed") >= since)
    if until is not None:
        walked = walked.filter(F.col("landed") <= until)
    return walked.join(times.select("sha", "idx"), "sha").withColumn("nth", F.row_number().over(Window.partitionBy("tip").orderBy(F.desc("idx")))).select("tip", "sha", "nth")


def is_fast_forward(old_tip: DataFrame, new_tip: DataFrame, parents: DataFrame, commits: DataFrame) -> bool:
    """Whether the one commit of ``old_tip(sha)`` is an ancestor of that of ``new_tip(sha)``; a commit that is gone is not."""
    placed = written(chains(parents, commits))
    pair = old_tip.select(F.col("sha").alias("ancestor"), F.lit(0).alias("_")).join(new_tip.select(F.col("sha").alias("of"), F.lit(0).alias("_")), "_").drop("_")
    row = is_ancestor(pair, placed, reachability(parents, placed)).first()
    return bool(row and row["is_ancestor"])
