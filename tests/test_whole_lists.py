"""Sections, image files and evidence without limits, against their oracles, and with them."""

import pytest
from pyspark.sql import functions as F
from test_oracles import SF, duck, entry, table

from tidemark.functions import text as T
from tidemark.operators import checks as K


@pytest.mark.parametrize("name", [base + end for base in ("f07_sections", "a33_image_files", "t08_evidence_pick") for end in ("", "_whole")])
def test_lists_match_their_oracles(spark, name):
    frame = entry.queries()[name](spark, SF)
    cursor = duck(SF).execute(entry.oracle_sql()[name])
    want = table([item[0] for item in cursor.description], cursor.fetchall())
    assert table(frame.columns, [tuple(row) for row in frame.collect()]) == want


def test_nothing_is_cut_without_a_limit(spark):
    long = spark.createDataFrame([("#### Why I did it\n" + "x" * 7000,)], "body string")
    row = long.select(T.sections(F.col("body"))["why"].alias("a"), T.sections(F.col("body"), 10)["why"].alias("b"), T.sections(F.col("body"), 10)["why_chars"].alias("n")).first()
    assert (len(row.a), len(row.b), row.n) == (7000, 10, 7000)
    items = spark.range(12).select(F.lit(1).alias("finding"), F.col("id").alias("number"), F.lit("r").alias("role"), F.lit(True).alias("cited"))
    assert K.pick_evidence(items).count() == 12 and {row.chosen for row in K.pick_evidence(items, 8).collect()} == {12}
