"""History features against plain loops over small hand-made and random histories."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history as H
from tidemark.operators import lineage as N
from tidemark.operators.checks import lookahead_problems
from tidemark.operators.prefix import dense_index, running, running_in_order

DAY, YEAR = 86400, 365 * 86400


def facts(spark, rows):
    schema = "idx bigint, sha string, landed bigint, author_id string, fix_like boolean, n_changes bigint"
    return spark.createDataFrame([(i, f"{i:040x}", landed, author, fix, n) for i, landed, author, fix, n in rows], schema)


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_running_totals_do_not_depend_on_the_block_width(spark, width):
    rng = random.Random(width)
    # One key holds two thirds of the rows.
    rows = [("hot" if rng.random() < 0.67 else f"k{rng.randrange(5)}", at, rng.randrange(9)) for at in range(200)]
    got = running(spark.createDataFrame(rows, "k string, at bigint, v bigint"), ["k"], "at", {"s": F.col("v")}, {"m": F.col("v")}, width=width)
    seen = defaultdict(list)
    want = {}
    for key, at, value in rows:
        want[at] = (sum(seen[key]), max(seen[key], default=None))
        seen[key].append(value)
    assert {row["at"]: (row["s"], row["m"]) for row in got.collect()} == want


def test_dense_index_is_the_position_in_the_order(spark):
    rows = [(i, (i * 7919) % 503) for i in range(503)]
    got = dense_index(spark.createDataFrame(rows, "id bigint, v bigint"), ["v"]).collect()
    assert all(row["idx"] == row["v"] for row in got) and len(got) == 503


def test_running_in_order_with_descending_scores(spark):
    rows = [("a", 0.9, 1), ("a", 0.5, 2), ("a", 0.7, 4), ("b", 0.1, 8)]
    got = running_in_order(spark.createDataFrame(rows, "k string, s double, n bigint"), ["k"], [F.desc("s")], {"c": F.col("n")}, width=2)
    assert {(row["k"], row["s"]): row["c"] for row in got.collect()} == {("a", 0.9): 1, ("a", 0.7): 5, ("a", 0.5): 7, ("b", 0.1): 8}


def test_landing_time_never_goes_back(spark):
    rows = [(0, 5), (1, 3), (2, 9), (3, 8)]
    got = H.landing_time(spark.createDataFrame(rows, "idx bigint, committed_epoch bigint"), width=2)
    assert [row["landed"] for row in got.orderBy("idx").collect()] == [5, 5, 9, 9]


def test_recent_experience_discounts_whole_years(spark):
    rows = [(0, 0, "a", False, 1), (1, 2 * YEAR, "a", False, 1), (2, 2 * YEAR, "a", False, 1)]
    got = H.recent_experience(facts(spark, rows), width=2).orderBy("idx").collect()
    assert [row["author_recent_experience"] for row in got] == [0.0, 0.333333, 1.333333]


def test_burst_counts_a_week_with_its_boundary(spark):
    f = facts(spark, [(i, i * DAY, "a", False, 1) for i in range(10)])
    areas = f.select("idx", "landed", F.lit("x").alias("area"))
    got = H.area_burst(f, areas, width=3).orderBy("idx").collect()
    assert [row["area_commits_last_7d"] for row in got] == [0, 1, 2, 3, 4, 5, 6, 7, 7, 7]


def test_area_rate_counts_a_revert_only_after_it_landed(spark):
    f = facts(spark, [(i, i * DAY, "a", False, 1) for i in range(4)])
    areas = f.select("idx", F.lit("x").alias("area"))
    reverts = spark.createDataFrame([(0, 2)], "target bigint, revert bigint")
    got = H.area_history(f, areas, reverts, width=2).orderBy("idx").collect()
    assert [(row["area_prior_commits"], row["area_revert_rate"]) for row in got] == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.333333)]


def brute_files(rows):
    """The sequential rules over (idx, landed, author, fix, changes)."""
    files, out = {}, {}
    for idx, landed, author, fix, changes in rows:
        paths = {old for status, old, _new in changes if old and status != "A"}
        live = [files[path] for path in paths if path in files]
        touched = set().union(*[{c for c, *_ in h} for h in live]) if live else set()
        ages = [(landed - h[-1][3]) / DAY for h in live]
        out[idx] = (
            len(touched), max((len(h) for h in live), default=0), len({a for h in live for _c, a, _f, _l in h}),
            len({c for h in live for c, _a, f, _l in h if f}), round(sum(ages) / len(ages), 3) if ages else None,
            round(1 - len(live) / len(changes), 6) if changes else 0.0,
        )
        for status, old, new in changes:
            if status == "R":
                history = files.pop(old, None) or []
                files[new] = history
            elif status == "D":
                history = files.pop(old, None) or []
            else:
                history = files.setdefault(new or old, [])
            history.append((idx, author, fix, landed))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_file_history_through_renames_and_deletes(spark, seed):
    rng = random.Random(seed)
    names = [f"f{i}" for i in range(6)]
    rows = []
    for idx in range(120):
        changes = []
        for _ in range(rng.randrange(0, 4)):
            status, old = rng.choice("MMMARDC"), rng.choice(names)
            new = rng.choice([name for name in names if name != old])
            changes.append({"M": ("M", old, old), "A": ("A", None, old), "R": ("R", old, new), "D": ("D", old, None), "C": ("C", old, new)}[status])
        rows.append((idx, idx * DAY // 2, rng.choice("abc"), rng.random() < 0.3, changes))
    f = facts(spark, [(idx, landed, author, fix, len(changes)) for idx, landed, author, fix, changes in rows])
    changes = spark.createDataFrame(
        [(idx, seq, *change) for idx, _l, _a, _f, cs in rows for seq, change in enumerate(cs)],
        "idx bigint, seq bigint, status string, old_path string, new_path string",
    )
    touches, reads = N.lineages(changes, width=16)
    got = H.file_history(f, touches.select("idx", "lineage"), reads, width=16).collect()
    keys = ("file_prior_changes", "file_prior_changes_max", "file_prior_authors", "file_prior_fix_touches", "file_days_since_last_change", "file_new_share")
    assert {int(row["sha"], 16): tuple(row[key] for key in keys) for row in got} == brute_files(rows)


def test_no_feature_looks_ahead(spark):
    f = facts(spark, [(i, i * DAY, "ab"[i % 2], False, 1) for i in range(12)])
    assert lookahead_problems(lambda part: H.author_prior(part), f, 7).count() == 0


def test_merge_bases_and_ancestors(spark):
    from tidemark.operators.backtest import ancestors_of

    # 0 - 1 - 2 - 3 with a side line 1 - 4 - 5 merged into 3.
    parents = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 2, 0), (4, 1, 0), (5, 4, 0), (3, 5, 1)], "sha int, parent int, ord int")
    reach = ancestors_of(spark.createDataFrame([(3,), (2,), (5,)], "sha int"), parents)
    found = defaultdict(set)
    for row in reach.collect():
        found[row["start"]].add(row["sha"])
    assert found == {3: {0, 1, 2, 3, 4, 5}, 2: {0, 1, 2}, 5: {0, 1, 4, 5}}
    chain = ancestors_of(spark.createDataFrame([(3,)], "sha int"), parents, first_only=True)
    assert {row["sha"] for row in chain.collect()} == {0, 1, 2, 3}
    pairs = spark.createDataFrame([(2, 5)], "left int, right int")
    assert N.merge_bases(reach.withColumn("idx", F.col("sha")), pairs).first()["base"] == 1


def test_lookahead_lists_every_excess_row_and_computes_each_table_once(spark):
    f = spark.range(6).selectExpr("id AS idx")
    seen = []

    def compute(part):
        last = part.agg(F.max("idx")).first()[0]
        seen.append(last)
        many = spark.range(2).selectExpr("id AS copy")
        return part.join(many, F.lit(True)).selectExpr("idx", f"CASE WHEN idx = 1 THEN {last} ELSE NULL END AS v")

    got = lookahead_problems(compute, f, 3)
    assert sorted(tuple(row) for row in got.collect()) == [(1, 3), (1, 3), (1, 5), (1, 5)] and seen == [5, 3]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 6") == 2


def test_lineages_without_readings_are_the_same(spark):
    rows = [(0, 0, "M", "a", "a"), (1, 0, "R", "a", "b"), (2, 0, "D", "b", "b"), (3, 0, "A", None, "a"), (3, 1, "R", "a", "c"), (4, 0, "M", "c", "c")]
    changes = spark.createDataFrame(rows, "idx bigint, seq bigint, status string, old_path string, new_path string")
    both = [N.lineages(changes, width=2, reading=reading) for reading in (True, False)]
    assert both[1][1] is None and both[0][1].count() == 5
    assert sorted(both[0][0].collect()) == sorted(both[1][0].collect())
