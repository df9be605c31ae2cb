import pytest
from pyspark.sql import functions as F

from tidemark.extension import DETECTORS, PathClass, Repository, reference_table, register_detector, run_detectors
from tidemark.operators import backtest as B
from tidemark.operators import checks as K
from tidemark.operators import ci as C
from tidemark.operators import coverage as V
from tidemark.operators import ledger as G


@pytest.fixture(scope="module")
def world(spark):
    entities = spark.createDataFrame([
        ("v/x86_64-a", "v", "device/v/x86_64-a", "amd64", ["alpha"]), ("v/arm64-b", "v", "device/v/arm64-b", "arm64", ["beta"]),
        ("v/x86_64-c", "v", "device/v/x86_64-c", "amd64", ["beta"]), ("w/odd", "w", "device/w/odd", "", ["beta"]),
        ("w/x86_64-d", "w", "device/w/x86_64-d", "amd64", ["gamma"]), ("w/x86_64-e", "w", "device/w/x86_64-e", "amd64", []),
    ], "id string, vendor string, directory string, arch string, families array<string>")
    groups = spark.createDataFrame([("alpha", "alpha", "amd64", ""), ("beta-arm64", "beta", "arm64", "arm64"), ("two", "delta", "amd64", "")],
                                   "name string, family string, arch string, qualifier string")
    return entities, groups


def test_three_disjoint_sets_and_two_totals(spark, world):
    entities, groups = world
    wanted = entities.select("id").union(spark.createDataFrame([("no/such",)], "id string"))
    result = V.coverage(wanted, entities, groups)
    rows = {r["id"]: (r["status"], r["resolution"], r["unknown"]) for r in result.collect()}
    assert rows == {
        "v/x86_64-a": ("covered", None, False), "v/arm64-b": ("ambiguous", "covered", False), "v/x86_64-c": ("ambiguous", "uncovered", False),
        "w/odd": ("ambiguous", "undetermined", False), "w/x86_64-d": ("uncovered", None, False), "w/x86_64-e": ("uncovered", None, True), "no/such": ("uncovered", None, True)}
    counts = V.coverage_counts(result).first()
    assert (counts["string_equality"], counts["architecture_aware"]) == (6, 4)
    assert V.partition_problems(result, wanted).count() == 0
    built, aliases = V.built_families(groups)
    assert {r[0] for r in built.collect()} == {"alpha", "beta-arm64", "two", "delta"} and [tuple(r) for r in aliases.collect()] == [("beta", "beta-arm64")]


def test_links_follow_chains_to_files_and_directories(spark):
    links = spark.createDataFrame([("d/a", "b"), ("d/b", "../e/c"), ("d/loop", "loop2"), ("d/loop2", "loop"), ("d/dir", "../shared/x")], "path string, target string")
    got = {r["path"]: r["resolved"] for r in V.resolve_links(links).collect()}
    assert got == {"d/a": "e/c", "d/b": "e/c", "d/loop": None, "d/loop2": None, "d/dir": "shared/x"}
    with pytest.raises(Exception, match="leaves the tree"):
        V.resolve_links(spark.createDataFrame([("a", "../../x")], "path string, target string")).collect()


def test_long_chains_are_followed_and_loops_are_not(spark):
    rows = [(f"l{i}", f"l{i + 1}") for i in range(20)] + [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("into", "r3")]
    got = {r["path"]: r["resolved"] for r in V.resolve_links(spark.createDataFrame(rows, "path string, target string")).collect()}
    assert all(got[f"l{i}"] == "l20" for i in range(20)) and all(got[f"r{i}"] is None for i in range(7)) and got["into"] is None


def test_reach_through_a_link_to_a_directory(spark, world):
    entities, _groups = world
    links = spark.createDataFrame([("device/v/x86_64-a/plugins", "device/v/common/plugins")], "path string, resolved string")
    changed = spark.createDataFrame([("device/v/common/plugins/p.py",), ("device/w/odd/f",), ("docs/x",)], "path string")
    found = V.affected(V.owning(changed, entities), V.reaching(changed, links, entities))
    assert sorted((r["path"], r["id"]) for r in found.collect()) == [("device/v/common/plugins/p.py", "v/x86_64-a"), ("device/w/odd/f", "w/odd")]


def test_hotspot_components_add_up(spark, world):
    entities, groups = world
    result = V.coverage(entities.select("id"), entities, groups)
    files = spark.createDataFrame([("device/w/x86_64-d/f", 1), ("docs/x", 6)], "path string, rank int")
    spots = V.hotspots(files, V.owning(files, entities), result, 6).orderBy("position").collect()
    assert [s["path"] for s in spots] == ["device/w/x86_64-d/f", "docs/x"] and spots[0]["score"] == 0.634 and spots[1]["score"] == 0.0


def test_shared_groups_win_over_the_union(spark):
    groups = reference_table(spark, {"g1": ["/r/a", "/r/b/", "/s/c"], "g2": ["r/b"]})
    both = spark.createDataFrame([("a/x",), ("b/y",), ("z",)], "path string")
    selected, assess = V.related_groups(both, groups, "r")
    assert [(r["grp"], r["rule"]) for r in selected.collect()] == [("g1", "shared")] and [tuple(r) for r in assess.collect()] == [("s", "c")]


def test_any_attempt_rule(spark):
    rows = [(1, "j", 1, 1, "failed"), (1, "j", 2, 2, "succeeded"), (2, "j", 3, 1, "succeeded"), (2, "j", 4, 2, "canceled"), (3, "j", 5, 1, "canceled"), (3, "j", 6, 2, None), (4, "j", 7, 1, None)]
    df = spark.createDataFrame(rows, "pr int, job string, build int, finish int, result string")
    assert {r["pr"]: r["result"] for r in C.any_attempt(df).collect()} == {1: "failed", 2: "succeeded", 3: "canceled", 4: None}


def test_outcome_is_the_first_build_after_the_score(spark):
    scores = spark.createDataFrame([("a", "m", 1, 5), ("b", "m", 1, 8), ("c", "m", 2, 0)], "subject string, model string, pr int, scored_at int")
    builds = spark.createDataFrame([(1, 10, 5, {"j": "succeeded"}), (1, 11, 9, {"j": "failed", "k": "canceled"}), (1, 12, 7, {"j": "canceled"}), (2, 13, 1, {"j": "canceled"}), (2, 14, 2, {"j": "failed"})],
                                   "pr int, build int, finish int, labels map<string,string>")
    assert {r["subject"]: (r["build"], r["y"]) for r in G.outcomes_after(scores, builds).collect()} == {"a": (10, 0), "b": (11, 1), "c": (None, None)}


def test_appends_are_unique_in_the_ledger_and_in_the_batch(spark):
    old = spark.createDataFrame([("s1", "m", 1)], "subject string, model string, n int")
    batch = spark.createDataFrame([("s1", "m", 2), ("s2", "m", 4), ("s2", "m", 3), ("s1", "k", 5)], "subject string, model string, n int")
    assert sorted(tuple(r) for r in G.fresh_rows(old, batch, ["n"], ["subject", "model"]).collect()) == [("s1", "k", 5), ("s2", "m", 3)]


def test_mentions_bind_hyphens_and_tags(spark):
    vocabulary = spark.createDataFrame([("platform", "v/a", "BX2700"), ("platform", "v/b", "BX2700-D48"), ("vendor", "fs", "fs"), ("family", "c s", "core switch")], "kind string, entity string, name string")
    texts = spark.createDataFrame([(1, "fix BX2700-D48 now"), (2, "[fs] x"), (3, "fs x"), (4, "a core switch."), (5, "[bx2700/y] z")], "id int, text string")
    got = sorted((r["id"], r["entity"], r["via"]) for r in B.mentions(texts, vocabulary).collect())
    assert got == [(1, "v/b", "subject"), (2, "fs", "subject_tag"), (4, "c s", "subject"), (5, "v/a", "subject_tag")]


def test_vendors_count_only_when_nothing_finer_is_named(spark):
    truth = spark.createDataFrame([(1, "vendor", "v"), (2, "vendor", "v"), (2, "family", "f9")], "id int, kind string, entity string")
    flagged = spark.createDataFrame([(1, "v/a"), (2, "v/a")], "id int, platform string")
    platforms = spark.createDataFrame([("v/a", "v")], "platform string, vendor string")
    families = spark.createDataFrame([("v/a", "f1")], "platform string, family string")
    assert [tuple(r) for r in B.match(truth, flagged, families, platforms).collect()] == [(1, "v/a", "v", "vendor")]


def test_medium_findings_stop_posting_after_five(spark):
    rows = [("r", i, "high", band, 1) for i, band in enumerate(["medium"] * 4 + ["high"] * 3 + ["low", None, "medium", "medium"])]
    df = spark.createDataFrame(rows, "report string, question int, severity string, band string, never_built int")
    got = {r["question"]: r["posted"] for r in K.rank_findings(df).collect()}
    assert [q for q, posted in sorted(got.items()) if posted] == [0, 1, 4, 5, 6]


def test_repositories_are_checked_when_made(spark):
    classes = (PathClass("build", 1, "build"), PathClass("rest", 2, "other"))
    repo = Repository("r", classes, (("rules/*", "build"),), "rest", markers=(("rules", "src"),))
    assert repo.class_rules() == [("rules/.*", "build")] and repo.class_table(spark).count() == 2 and repo.marker_table(spark).count() == 2
    for bad in ({"fallback": "build"}, {"rules": (("x", "no"),)}, {"classes": classes[:1] + (PathClass("rest", 3, "other"),)}):
        with pytest.raises(ValueError):
            Repository(**{"name": "r", "classes": classes, "rules": (), "fallback": "rest", **bad})


def test_detectors_merge_by_first_id(spark):
    DETECTORS.clear()
    register_detector("one", lambda x: x.select("id", F.lit("one").alias("by")))
    register_detector("two", lambda x: x.select((F.col("id") + 1).alias("id"), F.lit("two").alias("by")))
    with pytest.raises(ValueError):
        register_detector("one", None)
    got = run_detectors({"x": spark.createDataFrame([(1,), (2,)], "id int")})
    assert sorted(tuple(r) for r in got.collect()) == [(1, "one"), (2, "one"), (3, "two")]
    DETECTORS.clear()
