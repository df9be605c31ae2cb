"""Every row is drawn in every sample, also where all rows have the same score."""

import hashlib

import __spark_entry__ as entry
from pyspark.sql import functions as F
from tidemark.operators import metrics as M


def test_intervals_are_those_of_draws_per_row(spark):
    rows = [(i, i % 3 % 2, 0.2 if i % 2 else 0.6) for i in range(40)]
    samples = 60

    def count(b, i):
        u, k, total, term = int(hashlib.md5(f"7:{b}:{i}".encode()).hexdigest()[:8], 16), 0, 0.36787944117144233, 0.36787944117144233
        while u >= round(total * 2**32):
            k += 1
            term /= k
            total += term
        return k

    brier = []
    for b in range(samples):
        w = [count(b, i) for i, _, _ in rows]
        brier.append(sum(k * (s - y) ** 2 for k, (_, y, s) in zip(w, rows)) / sum(w))
    got = {r["metric"]: r for r in M.bootstrap(spark.createDataFrame(rows, "row_id long, y int, score double"), samples, seed=7).collect()}
    at = lambda q: (lambda v, x: v[int(x)] + (v[min(int(x) + 1, samples - 1)] - v[int(x)]) * (x - int(x)))(sorted(brier), q * (samples - 1))
    assert got["brier"]["samples"] == samples
    assert abs(got["brier"]["ci_low"] - at(0.025)) < 2e-6 and abs(got["brier"]["ci_high"] - at(0.975)) < 2e-6


def test_sql_draws_rows(spark):
    assert "row_id)), 1, 8)" in entry.oracle_sql()["a18_bootstrap_intervals"] and "atoms" not in entry.oracle_sql()["a18_bootstrap_intervals"]
    assert spark.range(1).select(F.expr(M.poisson_count("0"))).first()[0] == 0
