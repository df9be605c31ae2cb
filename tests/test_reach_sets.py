"""Entities reached through large sets are counted per set, and units are named per class, never in pairs."""

import random

from tidemark.operators import coverage as V
from tidemark.plans import reach
from test_oracles import SF


def test_sets_and_rows_reach_what_pairs_reach_once(spark):
    rng = random.Random(3)
    wide = [(f"w{i % 4}", f"e{i}") for i in range(30)] + [("w1", "e0"), ("w2", "e5")]
    narrow = [(f"n{i % 9}", f"e{rng.randrange(34)}") for i in range(40)]
    changed = [(rng.randrange(6), rng.choice([f"w{rng.randrange(4)}", f"n{rng.randrange(9)}"])) for _ in range(30)]
    frame = lambda rows: spark.createDataFrame(rows, "path string, id string")
    sets, members, rows = V.reached_sets(spark.createDataFrame(changed, "rev int, path string"), frame(wide), frame(narrow), ["rev"])
    got = sorted((r["rev"], r["id"]) for part in (sets.join(members, "path"), rows) for r in part.select("rev", "id").collect())
    assert got == sorted({(rev, id) for rev, path in changed for at, id in wide + narrow if at == path})
    answers = spark.createDataFrame([(f"e{i}", ["covered", "uncovered", "ambiguous"][i % 3], "uncovered" if i % 6 == 2 else None, i % 2 == 0) for i in range(34)],
                                    "id string, status string, resolution string, unknown boolean")
    pairs = spark.createDataFrame(got, "rev int, id string").join(answers, "id")
    assert sorted(V.set_counts(sets, members, rows, answers, ["rev"]).collect()) == sorted(V.coverage_counts(pairs, ["rev"]).collect())


def test_units_are_named_by_the_first_holder(spark):
    names = spark.createDataFrame([(0, "u1"), (0, "u2"), (1, "u2"), (2, "u3")], "cls int, name string")
    holders = spark.createDataFrame([(0, "b", "d/2"), (0, "a", "d/3"), (1, "c", "d/1")], "cls int, id string, directory string")
    assert sorted(tuple(r) for r in V.shared_units(names, holders).collect()) == [("u1", "b"), ("u2", "c")]


def test_the_entity_index_reads_one_unit_of_each_entity(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(V, "entity_index", lambda tree, *rest: seen.append(tree))
    reach.QUERIES["p23_entity_index"](spark, SF)
    units = seen[0].filter("path LIKE '%/port.ini'")
    assert units.count() == units.selectExpr("regexp_replace(path, '/unit.*', '')").distinct().count() > 0
