from tidemark.operators import ancestry as A


def size(frame):
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length()


def test_a_long_history_does_not_swell_the_planners_sizes(spark):
    edges = spark.range(1, 1500).selectExpr("id AS sha", "id - 1 AS parent", "0 AS ord")
    edges = edges.unionByName(spark.range(700, 1500, 100).selectExpr("id AS sha", "10000 AS parent", "1 AS ord"))
    commits = spark.range(1500).selectExpr("id AS sha").unionByName(spark.createDataFrame([(10000,)], "sha bigint"))
    placed = A.chains(edges, commits)
    assert size(placed) < 100
    index = A.reachability(edges, placed)
    assert size(index) < 100 and index.count() == 1501 + 800
