"""Small document tables for the tests of the text operators."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
# Names that operators use inside; a table may have them as well.
CLASHING = T.StructType([*SCHEMA.fields, *[T.StructField(name, T.StringType()) for name in ("key", "mark", "block", "n", "node", "digest", "hash", "place", "text_sha256")]])


def frame(spark, rows, clashing=False):
    full = [(*row, None, None, len(row[1] or "")) if len(row) == 2 else row for row in rows]
    if clashing:
        return spark.createDataFrame([(*row, *["x"] * 9) for row in full], CLASHING)
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abdeiklmnorstuü") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    return [rng.choice(names) + rng.choice(["", "", "", ",", "."]) for _ in range(n)]


def odd_rows():
    """Nulls, empty and blank texts, one long text, repeated rows and ids."""
    long = " ".join(prose(9, 6000, 3000))
    return [(None, None), (None, "one text without an id"), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "word"), (4, "word"), (4, "other"),
            (5, " \x00 é"), (6, long), (7, long), (8, "\n\n\n"), (-3, "negative id"), (9, "two words")]


def near_rows(seed=1, families=12):
    rng = random.Random(seed)
    rows, at = [], 0
    for family in range(families):
        base = prose(seed * 100 + family, rng.randint(30, 250))
        for _ in range(rng.randint(1, 14)):
            copy = [word if rng.random() > rng.choice([0.0, 0.02, 0.06, 0.1]) else rng.choice(base) for word in base]
            rows.append((at, " ".join(copy)))
            at += 1
    rng.shuffle(rows)
    return rows
