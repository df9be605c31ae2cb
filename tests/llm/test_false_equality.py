"""Inputs that once gave wrong answers: words that fool polynomials, many rows without an id, many equal rows, clusters of strangers."""

import random

from helpers import frame, prose

from tidemark.llm import near
from tidemark.llm.near import near_duplicates
from tidemark.llm.substring import without_repeats
from tidemark.llm.suffixes import without_repeated_bytes


def thue_morse():
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_fool_polynomials_differ(spark):
    one, two = thue_morse()
    start = [f"w{at}" for at in range(12)]
    docs = frame(spark, [(1, " ".join([*start, one])), (2, " ".join([*start, two])), (3, one), (4, two)])
    assert {row.key: row.n_removed for row in without_repeats(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert {row.key: row.component for row in near_duplicates(docs, 2, 90).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_rows_without_an_id_keep_their_own_answers(spark):
    # Among so many rows marks of 32 bits would collide with a probability of over 0.99.
    shared = " ".join(f"s{at}" for at in range(13))
    rows = [(None, f"only words of row {at} and a few more of them so that it has over thirteen") for at in range(300_000)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows + [(1, shared), (None, "x " + shared)], 8), "doc_id bigint, text string")
    got = without_repeats(docs).filter("n_removed > 0").collect()
    assert [(row.n_words, row.n_removed) for row in got] == [(14, 13)]


def test_many_equal_rows_cost_no_more_than_their_number(spark):
    text, other = " ".join(prose(1, 200)), " ".join(prose(2, 200))
    docs = frame(spark, [(5, text)] * 3000 + [(6, text + " end"), (7, other), (None, other)])
    got = {}
    for row in without_repeats(docs).collect():
        got.setdefault(row.key, set()).add(row.n_removed)
    assert got == {5: {0}, 6: {200}, 7: {0}, near.NO_ID: {200}}
    kept = without_repeated_bytes(docs).collect()
    assert len(kept) == 3003 and all(row.n_removed >= row.n_bytes - 4 for row in kept)


def test_a_cluster_of_strangers_gives_few_pairs(spark, monkeypatch):
    """Texts of one template, each a little too far from all others: what leaves a step grows with members, not with their pairs."""
    rng = random.Random(4)
    base = [f"t{at}" for at in range(200)]
    counts = []
    for many in (200, 800):
        rows = []
        for at in range(many):
            words = list(base)
            for place in rng.sample(range(200), 10):
                words[place] = f"d{at}x{place}"
            rows.append((at, " ".join(words)))
        made = []
        landed = near.landed

        def counting(df, name, made=made, landed=landed):
            out = landed(df, name)
            if name == "pairs":
                made.append(out.count())
            return out

        monkeypatch.setattr(near, "landed", counting)
        got = near_duplicates(frame(spark, rows), 2, 80).collect()
        monkeypatch.setattr(near, "landed", landed)
        assert sum(row.key == row.component for row in got) > many * 0.9
        counts.append(sum(made))
    assert counts[1] < 12 * 800 and counts[1] < 8 * counts[0]
