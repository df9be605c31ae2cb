import os

import numpy as np
import pytest
from helpers import frame, odd_rows, prose
from pyspark.sql import functions as F

from tidemark.llm import language, quality

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_isotonic_pools_violations():
    assert quality.isotonic(np.array([1.0, 3, 2, 2, 5]), np.ones(5)).round(6).tolist() == [1, 2.333333, 2.333333, 2.333333, 5]
    assert quality.isotonic(np.array([3.0, 1]), np.array([1.0, 3])).tolist() == [1.5, 1.5]


@needs_tables
def test_quality_on_held_out_rows(spark):
    scored = quality.op10_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(0 <= row.score <= 1 and row.predicted == int(row.score >= 0.5) for row in scored)
    held = [row for row in scored if row.held_out]
    assert len(held) > 50 and np.mean([row.predicted == row.quality for row in held]) > 0.95


def test_quality_of_odd_rows_and_missing_labels(spark):
    rows = odd_rows()
    docs = frame(spark, rows, clashing=True)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {row.score for row in quality.quality_scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(key, 1, None) for key in (1, 2, 3, 4, 5, None)] + [(6, None, 1)], "doc_id bigint, quality int, toxic int")
    got = quality.quality_scores(docs, one).collect()
    assert len(got) == len(rows) and all(0 <= row.score <= 1 for row in got)
    assert quality.accepted(docs, none).columns == docs.columns and quality.accepted(docs, none).count() == len(rows)
    assert quality.quality_scores(frame(spark, []), one).count() == quality.accepted(frame(spark, []), one).count() == 0


def test_same_text_same_score_whatever_stands_next_to_it():
    texts = [(" ".join(prose(at, 40 + at)) + "\n!! AB").encode() for at in range(20)] + [b"", b" "]
    ends = np.cumsum([len(text) for text in texts])
    whole = quality.statistics(np.frombuffer(b"".join(texts), np.uint8), ends)
    for at, text in enumerate(texts):
        assert np.allclose(whole[at], quality.statistics(np.frombuffer(text, np.uint8), np.array([len(text)]))[0])
    grams = language.grams(np.frombuffer(b"".join(texts), np.uint8), ends)
    for at, text in enumerate(texts):
        assert np.allclose(grams[at], language.grams(np.frombuffer(text, np.uint8), np.array([len(text)]))[0])


@needs_tables
def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.op3_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 150 and np.mean([row.lang == row.lang_pred for row in got]) > 0.97


def test_languages_of_odd_rows(spark):
    rows = odd_rows() + [(70, "123 !! 456")]
    docs = frame(spark, rows, clashing=True)
    untaught = language.languages(docs, language.fitted(docs)).collect()
    assert len(untaught) == len(rows) and {(row.lang_pred, row.score) for row in untaught} == {("und", 0.0)}
    taught = frame(spark, [(at, " ".join(prose(at % 3, 50)), ("en", "de", "zz")[at % 3], None, 0) for at in range(90)])
    model = language.fitted(taught)
    assert model.tree == {"germanic": ["de", "en"], "only zz": ["zz"]}
    got = language.languages(taught, model).join(taught.select(F.col("doc_id").alias("key"), "lang"), "key").collect()
    assert all(row.lang_pred == row.lang and 0.5 < row.score <= 1 for row in got)
    odd = language.languages(docs, model).collect()
    assert {row.lang_pred for row in odd if row.key in (2, 3, 8, 70)} == {"und"} and all(row.lang_pred != "und" for row in odd if row.key in (4, 6))
    single = language.languages(docs, language.fitted(taught.filter("lang = 'zz'"))).collect()
    assert {row.lang_pred for row in single} == {"und", "zz"}
