import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import documents as W
from tidemark.operators import models as M
from tidemark.sources import dataset as S
from tidemark.sources import manifest, trees
from tidemark.sources import history_text as X


def test_parts_hold_ordered_rows_with_sorted_keys(spark, tmp_path):
    df = spark.range(25).select(F.col("id").alias("idx"), F.lit("x").alias("b"), F.lit("y").alias("a"))
    S.write_json_parts(df, str(tmp_path / "r"), rows=10, compress=False)
    S.write_json_parts(df.filter("idx < 20"), str(tmp_path / "r"), rows=10, compress=False)
    files = sorted((tmp_path / "r").glob("part-*.json"))
    lines = [line for file in files for line in file.read_text().splitlines()]
    assert len(lines) == 20 and all(len(file.read_text().splitlines()) <= 10 for file in files) and lines[0].startswith('{"a":')
    (tmp_path / "r" / "junk.tmp").write_text("not json")
    assert S.read_json_parts(spark, str(tmp_path / "r"), "idx bigint, a string").count() == 20


def test_a_missing_feature_table_says_what_to_do(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="build the dataset"):
        S.read_features(spark, str(tmp_path / "none"))


def test_corpus_version_is_checked(spark, tmp_path):
    one = spark.range(1)
    S.write_corpus({"incidents": one, "controls": one, "candidates": one, "manifest": one}, str(tmp_path), "1")
    assert S.read_corpus(spark, str(tmp_path), "1")["controls"].count() == 1
    with pytest.raises(ValueError):
        S.read_corpus(spark, str(tmp_path), "2")


def test_steps_are_skipped_only_with_the_same_fingerprint(spark, tmp_path):
    path, mark = str(tmp_path / "m"), manifest.fingerprint("v1", "tip")
    for at, name in ((1, "old"), (2, mark)):
        manifest.commit_step(path, spark.createDataFrame([("mine", name, "c", ["f"], at)], manifest.MANIFEST))
    table = spark.read.schema(manifest.MANIFEST).json(path)
    assert len(mark) == 16 and manifest.is_fresh(table, "mine", mark) and not manifest.is_fresh(table, "mine", "old") and not manifest.is_fresh(table, "x", mark)


def test_fixtures_know_what_they_lack(spark):
    entries = spark.createDataFrame([("a", "s1"), ("b", "s2")], "path string, sha string")
    blobs = spark.createDataFrame([("s1", "text")], "sha string, content string")
    assert [r["path"] for r in trees.missing_blobs(entries, blobs).collect()] == ["b"]
    with pytest.raises(Exception, match="lacks blob"):
        trees.fixture(entries, blobs).collect()
    assert trees.fixture(entries.filter("path = 'a'"), blobs).first()["content"] == "text"


def test_numstat_lines(spark):
    rows = ["1\t2\ta", "-\t-\tb.bin", "3\t0\tx/{old => new}", "bad", "1\t1\tp => q"]
    got = X.numstat(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [tuple(r) for r in got] == [("a", 1, 2, False), ("b.bin", None, None, True), ("new", 3, 0, False), ("q", 1, 1, False)]


def test_missing_counts_are_an_error(spark):
    raw = spark.createDataFrame([("s", "M", "a", "a", "1", "1", "x", "y")], "sha string, status string, old_path string, new_path string, old_mode string, new_mode string, old_blob string, new_blob string")
    counts = spark.createDataFrame([("s", None, "b", 1, 1, False)], "sha string, old_path string, new_path string, additions int, deletions int, binary boolean")
    with pytest.raises(Exception, match="no line counts"):
        X.join_counts(raw, counts).collect()


def test_texts_are_read_whole(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "test_a.py").write_text("x\n@pytest.mark.topology('t0')\n")
    (tmp_path / "t" / "b.txt").write_text("@pytest.mark.topology('no')")
    found = X.topology_marks(X.read_texts(spark, str(tmp_path), "*.py"))
    assert [r["topology"] for r in found.collect()] == ["t0"]


def test_documents_cut_the_diff_at_a_line(spark):
    file = "struct<status:string,old_path:string,new_path:string,file_class:string,binary:boolean,additions:int,deletions:int,patch:string,patch_truncated:boolean,scopes:array<string>>"
    schema = f"""commit struct<sha:string,committed_at:string>, message struct<subject:string,body:string,subject_tags:array<string>,pr_number:bigint,
        sections:map<string,string>,revert:struct<is_revert:boolean,reverts_sha:string,reverts_pr:bigint>>, files array<{file}>,
        submodules array<struct<name:string,old_sha:string,new_sha:string>>, areas struct<components:array<struct<id:string>>,features:array<struct<id:string>>,entities:array<struct<id:string>>>"""
    def record(patch, body="b"):
        return (("s1", "T"), ("Fix", body, ["ci"], 5, {}, (True, "a" * 40, 3)), [("M", "a", "a", "code", False, 1, 2, patch, False, ["f"])], [("m", None, "c" * 40)], ([("c1",)], [], []))

    short, long = (W.documents(spark.createDataFrame([record(patch)], schema), budget=900).first() for patch in ("+x\n+y\n", "\n".join(f"+{i:030d}" for i in range(60))))
    assert short["text"] == (
        "Commit s1 landed T\nSubject: Fix\nTags: ci\nPR: #5\nReverts: commit aaaaaaaaaaaa, PR #3\nSubmodule m: added -> cccccccccccc\nComponents: c1\n"
        "Feature areas: none\nEntities: none\n\nMessage:\nb\n\nFiles (1, +1 -2):\nM code      a +1 -2 in: f\n\nDiff (zero context):\n--- a\n+x\n+y")
    assert short["diff_complete"] and not long["diff_complete"] and long["chars"] <= 900
    assert long["text"].endswith("[truncated]") and long["text"].split("\n")[-2].startswith("+0000")


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        churn, rate = rng.randrange(1, 400), rng.random()
        risky = rng.random() < 0.05 + 0.5 * (churn > 250) * rate
        split = "train" if i < 600 else "validation" if i < 750 else "test"
        rows.append((f"s{i}", i, i, split, rng.choice(["fix", "docs"]), i % 97 == 0, churn, rate, None if i % 5 == 0 else float(i % 9), i % 3, risky))
    return spark.createDataFrame(rows, "sha string, idx bigint, landed bigint, split string, change_type string, is_merge boolean, churn bigint, area_revert_rate double, days double, author_prior bigint, label_bug boolean")


def test_columns_never_hold_identities_or_labels(table):
    spec = M.column_spec(table)
    assert spec.numeric == ("churn", "area_revert_rate", "days") and spec.log == ("churn", "days") and spec.missing == ("days",)
    assert M.ColumnSpec.from_json(spec.to_json()) == spec


def test_models_beat_prevalence_and_stay_calibrated(spark, table):
    risk, rows = M.train_risk(table, "bug", iterations=3, grid_c=(0.1, 1.0), grid_boost=((0.1, 3),), card_sha="c")
    values = {(r["model"], r["split"], r["metric"]): r["value"] for r in M.evaluate(risk, rows).collect()}
    assert values[(risk.selected, "test", "pr_auc")] > values[("prevalence", "test", "pr_auc")]
    assert values[(risk.selected, "validation", "brier")] < 0.25
    done = M.score_changes(risk, rows.filter("split = 'test'"), rows, "c")
    first = done.first()
    assert 0 <= first["probability"] <= 1 and len(first["reasons"]) == 5 and 0 < first["percentile"] <= 100
    with pytest.raises(ValueError, match="different build"):
        M.score_changes(risk, rows, rows, "other")
    assert M.walk_forward(risk, rows, "t").count() == rows.filter("split <> 'train'").count()
    risk.final = True
    with pytest.raises(ValueError, match="out of sample"):
        M.walk_forward(risk, rows, "t")


def test_platt_of_one_class_is_the_identity(spark):
    assert M.fit_platt(spark.createDataFrame([(1.0, 0.3), (1.0, 0.6)], "y double, score double")) == (1.0, 0.0)


def test_fold_sizes(spark):
    got = M.folds(spark.range(13).select(F.col("id").alias("idx"))).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in got] == [3, 3, 3, 2, 2]
