"""Prefixes meet keys once, by their common head; keys without such a head are never cut to each length."""

from pyspark.sql import functions as F

from tidemark.operators import splits as S


def test_pairs_equal_brute_force(spark):
    keys = [format(i * 2654435761 % 2**32, "08x") for i in range(300)] + ["abcdefgh", "abcdefgi", "abc", "", None]
    prefixes = [key[: 2 + at % 5] for at, key in enumerate(keys[:60])] + ["abcdefg", "abcdefgh", "zz", "abcdefgh"]
    got = S.prefix_pairs(spark.createDataFrame([(k,) for k in keys], "k string"), "k", spark.createDataFrame([(p,) for p in prefixes], "prefix string"))
    assert sorted(map(tuple, got.collect())) == sorted((k, p) for k in keys if k is not None for p in set(prefixes) if k.startswith(p))
    assert S.prefix_pairs(spark.createDataFrame([("a",)], "k string"), "k", spark.createDataFrame([], "prefix string")).count() == 0


def test_keys_are_not_exploded_by_length_before_they_meet_a_prefix(spark):
    keys = spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("k"))
    prefixes = keys.limit(20).select(F.expr("left(k, 12 + CAST(rand(1) * 20 AS INT))").alias("prefix"))
    plan = S.resolve_prefixes(keys, "k", prefixes)._jdf.queryExecution().optimizedPlan().toString()
    exploded = plan.index("explode")
    assert "_head" in plan[exploded:] and plan.count("explode") == 1
    assert S.resolve_prefixes(keys, "k", prefixes).filter("matches = 1").count() == 20
