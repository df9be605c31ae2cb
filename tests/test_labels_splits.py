from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tidemark.operators import labels as L
from tidemark.operators import splits as S

DAY = 86400


def commits(spark, rows):
    """rows of (idx, is_revert, reverts_sha, reverts_pr, pr_number, is_merge)"""
    schema = "idx bigint, sha string, is_revert boolean, reverts_sha string, reverts_pr bigint, pr_number bigint, is_merge boolean"
    data = [(i, f"s{i}", r, s, p, n, m) for i, r, s, p, n, m in rows]
    return spark.createDataFrame(data, schema).withColumn("landed", F.col("idx") * DAY).withColumn(
        "submodule_only", F.lit(False)).withColumn("szz_eligible", F.lit(True))


def test_links_by_key_then_by_number_and_the_earliest_wins(spark):
    c = commits(spark, [
        (0, False, None, None, 10, False), (1, False, None, None, 11, False), (2, True, "s0", None, 12, False),
        (3, True, "s0", None, 13, False), (4, True, "s9", 11, 14, False), (5, True, None, 99, 15, False), (6, True, "s2", None, None, False),
    ])
    links = {row["target"]: (row["revert"], row["method"], row["nested"]) for row in L.link_reverts(c).collect()}
    assert links == {0: (2, "sha", False), 1: (4, "pr", False), 2: (6, "sha", True)}
    stats = L.revert_stats(c).first().asDict()
    assert stats == {"reverts": 5, "linked_by_sha": 3, "linked_by_pr": 1, "unlinked": 1, "nested": 1}


def test_a_younger_key_falls_back_to_the_number(spark):
    c = commits(spark, [(0, False, None, None, 7, False), (1, True, "s2", 7, None, False), (2, False, None, None, 8, False)])
    assert [(row["target"], row["method"]) for row in L.link_reverts(c).collect()] == [(0, "pr")]


def test_windows_and_unknowns(spark):
    c = commits(spark, [(0, False, None, None, None, False), (1, False, None, None, None, True), (8, True, "s0", None, None, False)])
    bugs = spark.createDataFrame([(0, 8, 1)], "introducer bigint, fix bigint, fix_count bigint")
    rows = {row["idx"]: row for row in L.commit_labels(c, L.link_reverts(c), bugs).collect()}
    assert rows[0]["reverted"] and not rows[0]["reverted_within_7d"] and rows[0]["reverted_within_30d"]
    assert rows[0]["revert_lead_days"] == 8.0 and rows[0]["bug_introducing"] and rows[0]["fix_lead_days"] == 8.0
    assert rows[1]["reverted"] is None and rows[1]["bug_introducing"] is None and rows[8]["bug_introducing"] is False
    blind = L.commit_labels(c, L.link_reverts(c), None).filter("idx = 0").first()
    assert blind["bug_introducing"] is None


def test_split_runs_on_a_thousand_days(spark):
    f = spark.range(1000).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("sha"), (F.col("id") * DAY).alias("landed"))
    rows, ends = S.assign_splits(f)
    names = [row["split"] for row in rows.orderBy("idx").collect()]
    assert [(name, len(list(run))) for name, run in groupby(names)] == [
        ("train", 548), ("gap", 89), ("validation", 47), ("gap", 89), ("test", 137), ("gap", 90)]
    assert {row["split"]: row["end"] // DAY for row in ends.collect()} == {"train": 637, "validation": 773, "test": 999}


def test_labels_count_only_what_was_known_at_the_end(spark):
    row = (True, 100, True, 300, True, True, False)
    schema = "reverted boolean, reverted_landed bigint, bug_introducing boolean, fixed_landed bigint, reverted_within_7d boolean, reverted_within_30d boolean, reverted_within_90d boolean"
    labels = spark.createDataFrame([row], schema).withColumn("split", F.lit("train"))
    ends = spark.createDataFrame([("train", 200)], "split string, end bigint")
    got = L.split_labels(labels, ends).first()
    assert (got["reverted"], got["bug_introducing"], got["reverted_within_7d"], got["reverted_within_90d"]) == (True, False, True, False)


@pytest.mark.parametrize("prefix,matches,key", [("abcdefg", 1, "abcdefg1"), ("abcdef", 0, None), ("1234567", 2, None)])
def test_prefixes_must_be_long_and_unique(spark, prefix, matches, key):
    keys = spark.createDataFrame([("abcdefg1",), ("12345678",), ("12345679",)], "k string")
    got = S.resolve_prefixes(keys, "k", spark.createDataFrame([(prefix,)], "prefix string")).first()
    assert (got["matches"], got["key"]) == (matches, key)


def test_entities_split_by_last_time_and_undated_ones_train(spark):
    rows = [(i, i) for i in range(20)] + [(99, None)]
    got = S.entity_split(spark.createDataFrame(rows, "pr bigint, finish bigint"), "pr", "finish").groupBy("split").count().collect()
    assert {row["split"]: row["count"] for row in got} == {"train": 15, "valid": 3, "test": 3}


@pytest.mark.parametrize("text,kept", [("x = 1", True), ("  };", False), ("", False), ("# note", False), ("#", False), ("#include", True), ("-- x", False)])
def test_trivial_lines(spark, text, kept):
    assert spark.createDataFrame([(text,)], "t string").select(L.is_meaningful_line(F.col("t"))).first()[0] is kept
