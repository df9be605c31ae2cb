"""Ground truth by parts: shared directories are looked up, not listed; results equal those over the listed truth."""

import random

import pytest

from tidemark.operators import backtest as B


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(3)
    subjects = spark.createDataFrame([(i, rng.choice(["x", "p3 broke", "[v1] p4", "fam1: y", "V2 only"])) for i in range(60)], "id long, subject string")
    pick = lambda: rng.choice([f"device/v/{rng.randrange(8)}/f", f"device/v/shared{rng.randrange(3)}/{rng.choice('ab')}", f"platform/fam{rng.randrange(3)}/z", "docs/a"])
    paths = spark.createDataFrame([(i, pick()) for i in range(60) for _ in range(rng.randrange(4))], "id long, path string")
    vocabulary = spark.createDataFrame(
        [("platform", f"v/{k}", f"p{k}") for k in range(8)] + [("family", f"fam{k}", f"fam{k}") for k in range(2)] + [("vendor", f"v{k}", f"v{k}") for k in range(3)],
        "kind string, entity string, name string")
    # Directory 0 has very many entities, some entities are in two directories, and own directories are shared ones too.
    shared = [("device/v/shared0", f"v/{k}") for k in range(700)] + [("device/v/shared1", f"v/{k}") for k in range(4, 12)] + [("device/v/3", "v/5"), ("device/v/3", "v/3")]
    shared = spark.createDataFrame(shared, "directory string, entity string")
    plats = [(f"v/{k}", f"v{k % 3}", f"fam{k % 4}", ("covered", "uncovered", "ambiguous")[k % 3 if k % 5 else 1]) for k in range(500)]
    return subjects, paths, vocabulary, shared, spark.createDataFrame(plats, "platform string, vendor string, family string, status string")


def brute_truth(world):
    """One row per (id, entity) with the first of its paths, own before shared, then the subject."""
    subjects, paths, vocabulary, shared, _ = world
    direct = B.mentions(subjects.selectExpr("id", "subject AS text"), vocabulary)
    rows = [(r["id"], r["kind"], r["entity"], True, "", 2, r["via"]) for r in direct.collect()]
    known = {k: {r["entity"] for r in vocabulary.collect() if r["kind"] == k} for k in ("platform", "family")}
    links = [(r["directory"], r["entity"]) for r in shared.collect()]
    for r in paths.distinct().collect():
        part = r["path"].split("/")
        if part[0] == "device":
            if "/".join(part[1:3]) in known["platform"]:
                rows.append((r["id"], "platform", "/".join(part[1:3]), False, r["path"], 0, "path"))
            rows += [(r["id"], "platform", entity, False, r["path"], 1, "shared_path") for directory, entity in links if directory == "/".join(part[:3])]
        elif part[0] == "platform" and part[1] in known["family"]:
            rows.append((r["id"], "family", part[1], False, r["path"], 0, "family_path"))
    best = {}
    for row in sorted(rows, key=lambda row: row[3:]):
        best.setdefault(row[:3], (row[6], row[4] or None))
    return {(*key, *value) for key, value in best.items()}


def test_truth_equals_brute_force(world):
    got = [tuple(r) for r in B.ground_truth(*world[:4]).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_truth(world)


def test_landing_and_matches_by_parts_equal_those_over_the_listed_truth(world):
    plats = world[4]
    families, vendors, status = plats.select("platform", "family"), plats.select("platform", "vendor"), plats.select("platform", "status")
    whole = B.ground_truth(*world[:4])
    direct, linked = B.evidence(*world[:4])
    assert linked.count() < whole.filter("via = 'shared_path'").count() / 100
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    assert rows(B.landing_rates_of(direct, linked, world[3], families, vendors, status)) == rows(B.landing_rates(B.landing(whole, families, vendors), status))
    flagged = world[0].select("id").crossJoin(plats.filter("platform < 'v/2'").select("platform", "status"))
    assert rows(B.match(direct, flagged, families, vendors, linked, world[3])) == rows(B.match(whole, flagged, families, vendors))
    items = world[0].selectExpr("id", "'incident' AS kind")
    assert rows(B.grade_items(items, flagged, direct, families, vendors, linked, world[3])) == rows(B.grade_items(items, flagged, whole, families, vendors))
