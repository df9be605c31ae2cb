import random
from itertools import permutations

import numpy as np
from helpers import frame, odd_rows, prose

from tidemark.llm.survivors import interactions, positional_counts

LABELS = "doc_id bigint, quality int, toxic int"


def brute(docs, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    texts = {}
    for doc, text, *_ in docs:
        texts.setdefault(text or "", []).append(doc)
    rows = []
    for doc, text, lang in docs:
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        ids = [d for d in texts[text] if d is not None]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": bool(ids) and (doc is None or doc > min(ids))}
        rows.append((lang or "", doc in good, doc in toxic, fails))
    out = set()
    for part in {row[0] for row in rows}:
        mine = [row for row in rows if row[0] == part]
        found, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [row for row in left if row[3][x]]
                left = [row for row in left if not row[3][x]]
                shapley[x] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone), sum(row[3][x] for row in mine) - len(gone),
                              sum(row[3][x] and sum(row[3].values()) == 1 for row in mine), sum(row[1] for row in gone), sum(row[2] for row in gone)))
        out |= {(*row, shapley[row[1][row[2] - 1]]) for row in found}
    return out


def test_interactions_match_brute_force(spark):
    rng = random.Random(5)
    docs = [(doc, text, rng.choice(["en", "de", None])) for doc, text in odd_rows()]
    for at in range(20, 120):
        words = prose(at % 60, rng.choice([40, 120, 150]), rng.choice([60, 4000]))
        words = [word.upper() if at % 4 == 0 else word for word in words] + ["5%"] * (at % 5 == 0)
        docs.append((at, " ".join(words), rng.choice(["en", "de", "fr"])))
    docs += [(7, docs[-1][1], "en"), (None, docs[-1][1], "en"), (200, docs[-1][1], "fr"), (200, docs[-1][1], "fr")]
    labels = [(doc, rng.choice([0, 1, None]), rng.choice([0, 1])) for doc, *_ in docs] + [(None, 1, 1), (20, 1, 0), (20, 0, 0)]
    got = interactions(frame(spark, [(doc, text, lang, None, 0) for doc, text, lang in docs]), spark.createDataFrame(labels, LABELS))
    rows = [tuple(row) for row in got.collect()]
    assert len(rows) == len({row[0] for row in docs and [(d[2] or "",) for d in docs]}) * 600
    assert set(rows) == brute(docs, labels)


def test_carry_save_counts_are_bit_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 5, 17, 1000):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        assert positional_counts(words).tolist() == [int(((words >> np.uint32(bit)) & 1).sum()) for bit in range(32)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], LABELS)
    assert interactions(frame(spark, []), empty).collect() == []
    rows = interactions(frame(spark, [(1, "a b")], clashing=True), empty).collect()
    assert len(rows) == 120 * 5 and all(row.kept == (1 if "A" not in row.filter_order[: row.step] else 0) for row in rows)
