import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators import similar as R


def brute_ap(rows):
    positives = sum(y for y, _ in rows)
    total, seen, hit, last = 0.0, 0, 0, 0.0
    for score in sorted({s for _, s in rows}, reverse=True):
        seen += sum(1 for _, s in rows if s == score)
        hit += sum(y for y, s in rows if s == score)
        total += (hit / positives - last) * hit / seen
        last = hit / positives
    return total


def brute_auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [0, 1])
def test_ranking_with_ties(spark, seed):
    rng = random.Random(seed)
    rows = [(int(rng.random() < 0.3), rng.randrange(12) / 12) for _ in range(150)]
    got = M.ranking(spark.createDataFrame(rows, "y int, score double")).first()
    assert math.isclose(got["pr_auc"], brute_ap(rows), abs_tol=1e-6) and math.isclose(got["roc_auc"], brute_auc(rows), abs_tol=1e-6)


def test_no_positive_has_no_value(spark):
    got = M.ranking(spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, score double")).first()
    assert got["pr_auc"] is None and got["roc_auc"] is None and got["positives"] == 0


@pytest.mark.parametrize("share,value", [(0.2, 0.5), (1.0, 1.0)])
def test_recall_at_effort(spark, share, value):
    rows = [(0, 1, 0.9, 10.0), (1, 0, 0.8, 10.0), (2, 1, 0.1, 10.0), (3, 0, 0.2, 70.0)]
    df = spark.createDataFrame(rows, "row_id int, y int, score double, effort double")
    assert M.recall_at_effort(df, share=share).first()["value"] == value


def test_wilson_stays_inside_and_is_null_without_trials(spark):
    df = spark.createDataFrame([(2, 20), (1, 20), (0, 0), (5, 5)], "k int, n int")
    got = [(row["r_low"], row["r_high"]) for row in df.select(*M.rate(F.col("k"), F.col("n"), "r")).collect()]
    assert got[0] == (0.0279, 0.301) and got[2] == (None, None) and got[3][1] == 1.0


def test_the_later_threshold_wins_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1)], "y int, score double")
    got = M.pick_threshold(df).first()
    assert got["threshold"] == 0.9 and got["f1"] == 1.0


def test_bootstrap_is_the_same_on_any_partitioning(spark):
    rows = [(i, i % 3 == 0, (i * 37 % 50) / 50) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id int, y boolean, score double").withColumn("y", F.col("y").cast("int"))
    one = sorted(map(tuple, M.bootstrap(df.coalesce(1), samples=10).collect()))
    many = sorted(map(tuple, M.bootstrap(df.repartition(7), samples=10).collect()))
    assert one == many and len(one) == 3


def brute_top(docs, items, idf_docs, k):
    words = {d: text.lower().split() for d, text in docs.items()}
    df, uses = {}, {}
    for d in idf_docs:
        for w in set(words[d]):
            df[w] = df.get(w, 0) + 1
    vocab = {w: math.log((1 + len(idf_docs)) / (1 + n)) + 1 for w, n in df.items() if n >= 2}
    vec = {}
    for d, ws in words.items():
        v = {w: (1 + math.log(ws.count(w))) * vocab[w] for w in set(ws) if w in vocab}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vec[d] = {w: x / norm for w, x in v.items()}
    out = {}
    for q in docs:
        scored = []
        for d in docs:
            if d < q and d % 5 != 4:
                cosine = sum(x * vec[d].get(w, 0) for w, x in vec[q].items())
                union = len(items[q] | items[d])
                jaccard = len(items[q] & items[d]) / union if union else 0.0
                scored.append((-round(0.6 * cosine + 0.4 * jaccard, 12), -d))
        out[q] = [-d for _s, d in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_top_similar_is_exact(spark, seed):
    rng = random.Random(seed)
    pool = [f"w{chr(97 + i)}{chr(97 + i)}" for i in range(14)]
    docs = {d: " ".join(rng.choices(pool, weights=[2 ** -(i / 2) for i in range(14)], k=rng.randrange(0, 9))) for d in range(40)}
    items = {d: {f"i{rng.randrange(12)}" for _ in range(rng.randrange(0, 3))} for d in docs}
    texts = spark.createDataFrame(list(docs.items()), "doc bigint, text string")
    counts = R.term_counts(texts)
    posts = R.postings(counts, R.vocabulary(counts, texts.filter("doc < 30").select("doc")))
    sets = spark.createDataFrame([(d, item) for d, own in items.items() for item in own], "doc bigint, item string")
    entries = texts.select("doc", F.col("doc").alias("idx"), (F.col("doc") % 5 != 4).alias("allowed"))
    got = R.top_similar(entries, posts, sets, entries.select("doc"), 4).orderBy("query", "rank").collect()
    found = {d: [] for d in docs}
    for row in got:
        found[row["query"]].append(row["doc"])
    assert found == brute_top(docs, items, range(30), 4)


def test_known_outcomes_are_strictly_before(spark):
    df = spark.createDataFrame([(True, 5, 6), (True, 6, 6), (False, None, 6), (None, None, 6)], "label boolean, event int, at int")
    got = [row[0] for row in df.select(R.known_at(F.col("label"), F.col("event"), F.col("at"))).collect()]
    assert got == [True, False, False, None]
