import hashlib
import random

import pytest
from helpers import frame, odd_rows, prose

from tidemark.llm.mixing import measured, mixed, source_rates, with_copies


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, with the excess over the bounds dealt again and again."""
    order = sorted((source for source in sizes if source is not None), key=str.encode) + [None] * (None in sizes)
    weight = {source: weights[at % len(weights)] for at, source in enumerate(order)}
    left, fixed = sum(sizes.values()), {}
    while len(fixed) < len(order):
        free = [source for source in order if source not in fixed]
        shares = {source: left * weight[source] / sum(weight[one] for one in free) for source in free}
        over = {source: most * sizes[source] for source in free if shares[source] > most * sizes[source] + 1e-9}
        if not over:
            return fixed | shares
        fixed |= over
        left -= sum(over.values())
    return fixed


def documents(seed, sources, many):
    rng = random.Random(seed)
    rows = []
    for at in range(many):
        source = rng.choice(sources)
        rows.append((at, " ".join(prose(at, rng.randint(1, 60 if source != "b" else 3))), None, source, 0))
    return rows


@pytest.mark.parametrize("sources", [["a"], ["a", "b", None], ["s10", "s2", "é", "Z", "b", "c", "", None]])
def test_targets_and_copies(spark, sources):
    docs = documents(len(sources), sources, 400)
    sizes = {}
    for _, text, _, source, _ in docs:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    table = frame(spark, docs)
    rows = with_copies(measured(table), source_rates(measured(table))).collect()
    targets = brute_targets(sizes)
    for row in rows:
        assert row.source_size == sizes[row.source] and row.target == pytest.approx(targets[row.source])
        draw = int(hashlib.md5(f"{row.doc_id}:{docs[row.doc_id][1]}".encode()).hexdigest()[:13], 16) / 16**13
        rate = targets[row.source] / row.source_size
        assert row.copies == int(row.rate) + (draw < row.cut) and row.copies <= 3 and row.rate == pytest.approx(rate)
        # The cut stays near the fraction: so many draws lie between that chance hardly gives more.
        assert abs(row.cut - (row.rate - int(row.rate))) < 0.5
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    again = with_copies(measured(table.repartition(7)), source_rates(measured(table.repartition(3)))).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)
    for source, size in sizes.items():
        taken = sum(row.size * row.copies for row in rows if row.source == source)
        assert abs(taken - targets[source]) <= max(row.size for row in rows if row.source == source) + 1
    copies = {row.doc_id: row.copies for row in rows}
    emitted = {}
    for row in mixed(table).collect():
        assert tuple(row) == docs[row.doc_id]
        emitted[row.doc_id] = emitted.get(row.doc_id, 0) + 1
    assert emitted == {doc: n for doc, n in copies.items() if n}


def test_odd_rows_and_empty_tables(spark):
    odd = frame(spark, [(doc, text, None, source, 0) for (doc, text), source in zip(odd_rows(), ["a", None, "b"] * 9)])
    rows = with_copies(measured(odd), source_rates(measured(odd))).collect()
    assert len(rows) == len(odd_rows()) and all(row.copies <= 3 for row in rows)
    nothing = frame(spark, [(1, None), (2, " "), (3, "")])
    assert [(row["size"], row.target, row.copies) for row in with_copies(measured(nothing), source_rates(measured(nothing))).collect()] == [(0, 0.0, 0)] * 3
    assert mixed(frame(spark, [])).collect() == []
    assert mixed(frame(spark, [(1, "a b")], clashing=True)).count() == 1
