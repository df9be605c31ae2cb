"""Reach per path instead of per change, and trees of which only what markers ask for is listed."""

import re

from pyspark.sql import functions as F

from tidemark.operators import coverage as V
from tidemark.plans import reach as P

D = "/root/testdata/sf0.001"


def test_hotspots_from_reach_per_path_equal_those_per_change(spark):
    files = spark.createDataFrame([(r, f"p{k}", k % 4 + 1) for r in range(4) for k in range(r, r + 4)], "rev int, path string, rank int")
    reached = spark.createDataFrame([(f"p{k}", f"e{j}") for k in range(6) for j in range(k)], "path string, id string")
    result = spark.createDataFrame([(f"e{j}", ("covered", "uncovered", "ambiguous")[j % 3]) for j in range(6)], "id string, status string")
    every = reached.join(files.select("rev", "path"), "path")
    each = every.select("rev", "id").distinct().join(result, "id")
    rows = lambda frame: sorted(map(tuple, frame.select("rev", "path", "fanout", "score", "position").collect()))
    assert rows(V.hotspots(files, reached, result, 6, ["rev"], limit=3)) == rows(V.hotspots(files, every, each, 6, ["rev"], limit=3))


def test_identify_on_a_tree_with_witnesses_equals_the_whole_tree(spark):
    whole = P.tree(spark, D).select("path")
    units = sorted(r["path"] for r in whole.filter("path like '%/unit%'").limit(50).collect())
    deep = re.sub(r"/port.ini$", "", units[0])
    markers = spark.createDataFrame([("a", 1, "device"), ("b", 1, deep), ("c", 1, units[-1]), ("d", 1, deep + "0x"), ("e", 1, "/".join(deep.split("/")[:3])), ("e", 1, "device")],
                                    "adapter string, grp int, marker string")
    listed = markers.select(F.explode(P.ancestors(F.col("marker"))).alias("directory"))
    small = P.tree(spark, D, listed).select("path")
    assert small.count() < whole.count()
    names = lambda frame: sorted(r[0] for r in V.identify(frame, markers).collect())
    assert names(small) == names(whole) == ["a", "b", "c", "e"]


def test_paths_climb_once_and_only_to_depths_with_roots(spark):
    paths = spark.createDataFrame([(r, f"d/v{k % 3}/e{k}/f") for r in range(5) for k in range(7)] + [(9, "d/v0"), (9, "d"), (9, None), (9, "d/v0")], "rev int, path string")
    roots = spark.createDataFrame([("d/v0", "a"), ("d/v1/e1", "b"), ("d/v0/e3", "c"), ("x", "e")], "up string, id string")
    got = sorted(map(tuple, V.under(paths, roots, ["rev"], []).collect()))
    brute = {(p["rev"], p["path"], r["id"]) for p in paths.collect() if p["path"] for r in roots.collect() if p["path"] == r["up"] or p["path"].startswith(r["up"] + "/")}
    assert got == sorted(brute)
    deep = roots.filter("up <> 'x'")
    entities = deep.withColumnRenamed("up", "directory")
    assert sorted(map(tuple, V.owning(paths, entities, ["rev"]).select("rev", "path", "id").collect())) == sorted(brute)
