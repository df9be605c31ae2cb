import random

import pytest

from tidemark.operators import intervals as I
from tidemark.streaming import flows

SCHEMA = "k bigint, start bigint, `end` bigint"


def units(rows):
    return {(k, at) for k, low, high in rows for at in range(low, high)}


def collected(frame):
    return sorted(tuple(row) for row in frame.select("k", "start", "end").collect())


@pytest.mark.parametrize("width", [1 << 20, 7])
def test_unions_and_gaps_match_sets_of_units(spark, width):
    rng = random.Random(width)
    rows = [(k, low, low + rng.choice([-2, 0, 1, 3, 9])) for k in range(4) for low in (rng.randrange(-20, 60) for _ in range(25))]
    found = collected(I.united(spark.createDataFrame(rows, SCHEMA), ["k"], width))
    assert units(found) == units(rows)
    # Disjoint, and none touches the next.
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(found, found[1:]))
    bounds = [(k, -30, 80) for k in range(5)]
    gaps = collected(I.open_between(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(bounds, SCHEMA), ["k"], width))
    assert units(gaps) == units(bounds) - units(rows)
    assert all(low < high for _, low, high in gaps)


def test_holes_are_filled_newest_first_up_to_the_cap(spark):
    fetched = spark.createDataFrame([(40, 50), (80, 90)], "start bigint, `end` bigint")
    got = lambda **options: sorted(tuple(row) for row in I.next_fetches(fetched, 100, 0, 5, **options).collect())
    assert got() == [(0, 40, "hole"), (50, 80, "hole"), (85, 100, "poll")]
    assert got(cap=35) == [(35, 40, "hole"), (50, 80, "hole"), (85, 100, "poll")]
    assert got(cap=10) == [(70, 80, "hole"), (85, 100, "poll")]
    nothing = spark.createDataFrame([], "start bigint, `end` bigint")
    assert [tuple(row) for row in I.next_fetches(nothing, 100, 20, 5).collect()] == [(20, 100, "poll")]


def test_a_changed_tip_is_mined_again_and_a_failed_walk_leaves_no_trace(spark, tmp_path):
    path = str(tmp_path / "mined")
    frames = lambda edges: (
        spark.createDataFrame([(a, b, 0) for a, b in edges], "sha bigint, parent bigint, ord int"),
        spark.createDataFrame([(sha,) for sha in sorted({x for edge in edges for x in edge})], "sha bigint"))
    seen = []

    def mine(new):
        seen.append(sorted(row.sha for row in new.collect()))
        return new

    rows = lambda: sorted(row.sha for row in flows.mined(spark, path).collect())
    assert flows.walks(spark, path) is None
    assert flows.walk_history(spark, path, *frames([(2, 1), (3, 2)]), 3, mine) == "rewritten" and rows() == [1, 2, 3]
    assert flows.walk_history(spark, path, *frames([(2, 1), (3, 2)]), 3, mine) == "fresh"
    assert flows.walk_history(spark, path, *frames([(2, 1), (3, 2), (4, 3)]), 4, mine) == "forward" and rows() == [1, 2, 3, 4]

    def broken(new):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        flows.walk_history(spark, path, *frames([(2, 1), (5, 2)]), 5, broken)
    assert rows() == [1, 2, 3, 4]
    assert flows.walk_history(spark, path, *frames([(2, 1), (5, 2)]), 5, mine) == "rewritten" and rows() == [1, 2, 5]
    assert seen == [[1, 2, 3], [4], [1, 2, 5]]
    assert [row.kind for row in flows.walks(spark, path).orderBy("walk").collect()] == ["rewritten", "forward", "rewritten"]
