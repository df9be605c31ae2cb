"""Poisson draws in SQL, Platt's Newton steps against a grid, importance of a linear model by terms against whole vectors."""

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators import models as P


def test_poisson_draws_have_the_mean_and_variance_of_their_size(spark):
    sizes = [1, 3, 7, 15, 16, 40, 1000]
    rows = spark.range(20000).withColumn("h", F.md5(F.col("id").cast("string")))
    for at in range(4):
        rows = rows.withColumn(f"u{at}", F.conv(F.substring("h", 8 * at + 1, 8), 16, 10).cast("bigint"))
    drawn = [F.expr(M.poisson_weight(f"CAST({size} AS BIGINT)", ["u0", "u1", "u2", "u3"])).alias(f"w{size}") for size in sizes]
    found = rows.select(*drawn).agg(*[f(f"w{size}") for size in sizes for f in (F.avg, F.var_samp)]).first()
    for at, size in enumerate(sizes):
        mean, variance = found[2 * at], found[2 * at + 1]
        assert abs(mean - size) < 5 * (size / 20000) ** 0.5 + 0.01
        assert abs(variance / size - 1) < 0.06


def test_bootstrap_work_is_that_of_distinct_scores(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.pmod(F.col("id") * 7, F.lit(10)) / 10).alias("score"))
    ends = {row["metric"]: (row["ci_low"], row["ci_high"]) for row in M.bootstrap(df, samples=200).collect()}
    whole = M.roc_auc(df).first()["value"]
    assert ends["roc_auc"][0] < whole < ends["roc_auc"][1] and ends["roc_auc"][1] - ends["roc_auc"][0] < 0.1
    assert M.bootstrap(df.limit(0), samples=5).count() == 0


def test_platt_is_at_the_optimum(spark):
    rng = np.random.default_rng(5)
    score = rng.uniform(0.02, 0.98, 400)
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-(0.7 * np.log(score / (1 - score)) - 0.4)))).astype(float)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(score, y)] + [(None, 1.0), (0.5, None)], "score double, y double")
    slope, intercept = P.fit_platt(rows)
    x = np.log(score / (1 - score))
    p = 1 / (1 + np.exp(-(slope * x + intercept)))
    assert abs(np.sum((y - p) * x)) < 1e-5 and abs(np.sum(y - p)) < 1e-6
    assert P.fit_platt(rows.filter("y = 1")) == (1.0, 0.0)
    parted = spark.createDataFrame([(0.1, 0.0), (0.2, 0.0), (0.8, 1.0), (0.9, 1.0)], "score double, y double")
    steep, _ = P.fit_platt(parted)
    assert np.isfinite(steep) and steep > 3


def test_linear_importance_by_terms_equals_whole_vectors(spark):
    rng = np.random.default_rng(1)
    data = [(at, float(rng.integers(0, 2)), 1.0, Vectors.dense([float(rng.integers(0, 4)), float(rng.normal()), 2.0])) for at in range(120)]
    rows = spark.createDataFrame(data, ["sha", "y", "effort", "x"]).repartition(3)
    model = P.fit_logistic(rows)

    class Whole:
        """The same model without its parts, so that whole vectors are scored."""

        def transform(self, frame):
            return model.transform(frame)

    by_terms = {row["feature"]: row["mean"] for row in P.permutation_importance(model, rows, ["a", "b", "c"], repeats=2).collect()}
    by_vectors = {row["feature"]: row["mean"] for row in P.permutation_importance(Whole(), rows, ["a", "b", "c"], repeats=2).collect()}
    assert by_terms.keys() == by_vectors.keys()
    assert all(abs(by_terms[name] - by_vectors[name]) < 1e-5 for name in by_terms)
    assert by_terms["c"] == 0
