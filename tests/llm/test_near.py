import re

import numpy as np
import pytest
from helpers import frame, near_rows, odd_rows

from tidemark.llm import near


def brute(rows, width, percent):
    sets, find = {}, {}
    for key, text in rows:
        words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        one = {tuple(words[i: i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
        sets.setdefault(key, []).append(one)
        find[key] = key

    def top(x):
        while find[x] != x:
            x = find[x]
        return x

    keys = sorted(sets)
    for at, a in enumerate(keys):
        for b in keys[at + 1:]:
            if any(one and two and 100 * len(one & two) >= percent * len(one | two) for one in sets[a] for two in sets[b]):
                x, y = sorted((top(a), top(b)))
                find[y] = x
    return {key: top(key) for key in keys}, {key: sorted(map(len, some)) for key, some in sets.items()}


@pytest.mark.parametrize("width,block", [(2, 1024), (5, 1024), (2, 3)])
def test_components_match_brute_force(spark, width, block):
    rows = [(key if key is not None else near.NO_ID, text) for key, text in odd_rows()] + [(key + 100, text) for key, text in near_rows()]
    want, sizes = brute(rows, width, 80)
    got = near.near_duplicates(frame(spark, [(None if key == near.NO_ID else key, text) for key, text in rows], clashing=True), width, 80, block=block).collect()
    assert len(got) == len(rows)
    assert {(row.key, row.component) for row in got} == set(want.items())
    for key, some in sizes.items():
        assert sorted(row.n_shingles for row in got if row.key == key) == some


def test_empty_table(spark):
    assert near.near_duplicates(frame(spark, [])).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    docs = frame(spark, near_rows() + [(500, "same words here"), (500, "same words here"), (501, ""), (502, None)], clashing=True)
    want, _ = brute([(row.doc_id, row.text) for row in docs.collect()], 5, 80)
    out = near.without_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(row.doc_id for row in out.collect()) == sorted(key for key, top in want.items() if key == top)


def test_estimates_are_close_and_registers_merge():
    rng = np.random.default_rng(3)
    errors = []
    for share in (0.5, 0.8, 0.9):
        for _ in range(30):
            both, a, b = (rng.integers(0, 1 << 63, int(n), dtype=np.uint64) for n in (1000 * share, 400 * (1 - share), 600 * (1 - share)))
            one, two = np.concatenate([both, a]), np.concatenate([both, b])
            r1, r2 = near.registers(one), near.registers(two)
            assert (np.maximum(r1, r2) == near.registers(np.concatenate([one, two]))).all()
            true = len(both) / (len(both) + len(a) + len(b))
            errors.append(near.estimated(r1[None], r2[None], np.array([len(one)]), np.array([len(two)]))[0] - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05 and min(errors) > -near.SLACK
