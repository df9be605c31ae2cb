"""Blame looks at the lines of fixes only, and strips each line once."""

from pyspark.sql import functions as F

from tidemark.operators import labels as L
from tidemark.plans import views as V


def test_a_line_is_stripped_once(spark):
    lines = spark.range(3).select(F.concat(F.lit(" # x"), "id").alias("t"))
    plan = lines.filter(L.is_meaningful_line(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_other_trees_do_not_become_lines(spark):
    d = "/root/testdata/sf0.001"
    wanted = spark.createDataFrame([(3,), (4,), (4,)], "sha bigint")
    for name, key in (("line_origin", "parent"), ("targets", "sha")):
        every = V.view(spark, d, name).filter(F.col(key).isin(3, 4))
        some = V.view_of(spark, d, name, wanted)
        assert some.count() == every.count() > 0 and some.exceptAll(every).isEmpty()


def test_line_table_travels_once(spark):
    fixes = spark.createDataFrame([(5, 50)], "idx bigint, parent bigint")
    targets = spark.createDataFrame([(5, "a", 1, 2), (6, "a", 1, 1)], "idx bigint, path string, range_start bigint, range_end bigint")
    origin = spark.createDataFrame([(50, "a", 1, 7, "x = 1"), (50, "a", 2, 7, "}"), (51, "a", 1, 7, "y")], "parent bigint, path string, line bigint, origin_sha bigint, text string")
    commits = spark.createDataFrame([(7, 1)], "sha bigint, idx bigint")
    got = L.attribute_bugs(fixes, targets, origin, commits)
    assert [tuple(row) for row in got.collect()] == [(1, 5, 2)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("origin_sha#") and "LeftSemi, ((parent" not in got._jdf.queryExecution().optimizedPlan().toString()
