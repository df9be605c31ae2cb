import random

import pytest

from tidemark.operators import ancestry as A


def graph(seed, n, lines=4):
    """Parents by commit: mostly one line each, forks and merges now and then, some roots."""
    rng = random.Random(seed)
    parents = {}
    for at in range(n):
        mine = [] if at == 0 or rng.random() < 0.03 else [rng.randrange(max(0, at - 6), at)]
        if mine and rng.random() < 0.3:
            other = rng.randrange(at)
            mine += [other] if other != mine[0] else []
        parents[at] = mine
    return parents


def closure(parents):
    reach = {}
    for at in sorted(parents):
        reach[at] = {at}.union(*[reach[p] for p in parents[at]])
    return reach


def frames(spark, parents):
    edges = [(at, p, nth) for at, mine in parents.items() for nth, p in enumerate(mine)]
    return spark.createDataFrame(edges, "sha bigint, parent bigint, ord int"), spark.createDataFrame([(at, at, at) for at in parents], "sha bigint, idx bigint, landed bigint")


@pytest.mark.parametrize("seed", [1, 2])
def test_index_answers_like_the_closure(spark, seed):
    parents = graph(seed, 60)
    reach = closure(parents)
    edges, commits = frames(spark, parents)
    placed = A.chains(edges, commits).cache()
    index = A.reachability(edges, placed)
    assert {row.sha: row.n_ancestors for row in A.ancestor_counts(index).collect()} == {at: len(some) for at, some in reach.items()}
    pairs = spark.createDataFrame([(a, b) for a in parents for b in parents] + [(999, 1), (1, 999)], "ancestor bigint, of bigint")
    got = {(row.ancestor, row.of): row.is_ancestor for row in A.is_ancestor(pairs, placed, index).collect()}
    assert got == {(a, b): a in reach.get(b, ()) for a, b in got} and len(got) == 60 * 60 + 2
    bases = A.merge_bases(spark.createDataFrame([(a, b) for a in range(0, 60, 7) for b in range(0, 60, 5)], "a bigint, b bigint"), placed, index, commits).collect()
    assert {(row.a, row.b): row.base for row in bases} == {(a, b): max(reach[a] & reach[b], default=None) for a in range(0, 60, 7) for b in range(0, 60, 5)}
    # One row per commit and chain reached, not one per ancestor.
    assert index.count() <= 60 * placed.select("chain").distinct().count()
    walked = {}
    for row in A.first_parent_walk(commits.filter("sha in (59, 40)"), edges, placed, commits, since=10).orderBy("tip", "nth").collect():
        walked.setdefault(row.tip, []).append(row.sha)
    for tip, found in walked.items():
        want, at = [], tip
        while at is not None:
            want += [at] if at >= 10 else []
            at = parents[at][0] if parents[at] else None
        assert found == want


def test_a_straight_history_has_one_row_per_commit(spark):
    edges, commits = frames(spark, {at: [at - 1] if at else [] for at in range(300)})
    placed = A.chains(edges, commits)
    assert A.reachability(edges, placed).count() == 300


def test_fast_forward(spark):
    edges, commits = frames(spark, {0: [], 1: [0], 2: [1], 3: [1]})
    one = lambda sha: spark.createDataFrame([(sha,)], "sha bigint")
    assert A.is_fast_forward(one(1), one(3), edges, commits)
    assert not A.is_fast_forward(one(2), one(3), edges, commits)
    assert not A.is_fast_forward(one(77), one(3), edges, commits)
    empty = frames(spark, {})
    assert A.chains(*empty).count() == 0
