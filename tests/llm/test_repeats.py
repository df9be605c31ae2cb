import hashlib
import random
from collections import defaultdict

import pytest
from helpers import frame, odd_rows, prose

from tidemark.llm import substring, suffixes


def passages(seed=5):
    """Documents built from shared passages with own words between, near copies and repeats inside one text."""
    rng = random.Random(seed)
    shared = [prose(seed * 50 + at, rng.choice([9, 13, 14, 40, 90])) for at in range(8)]
    rows = []
    for at in range(60):
        words = []
        for _ in range(rng.randint(1, 6)):
            words += rng.choice(shared)[rng.choice([0, 0, 3]):] if rng.random() < 0.5 else prose(rng.randint(0, 10**6), rng.randint(1, 30))
        if rng.random() < 0.3 and rows:
            words = rows[rng.randrange(len(rows))][1].split()
            words[rng.randrange(len(words))] = "changed"
        rows.append((at * 3 % 61, " ".join(words)))
    rows.append((200, "a" * 700))
    rows.append((201, "the same line again\n" * 40))
    return rows


def brute_words(rows, length=13):
    first = {}
    texts = [(key, (text or "").encode().split()) for key, text in rows]
    for key, words in texts:
        for at in range(len(words) - length + 1):
            window = tuple(words[at: at + length])
            first[window] = min(first.get(window, key), key)
    out = []
    for key, words in texts:
        gone = set()
        for at in range(len(words) - length + 1):
            if first[tuple(words[at: at + length])] < key:
                gone.update(range(at, at + length))
        kept = b" ".join(word for at, word in enumerate(words) if at not in gone)
        out.append((key, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_bytes(rows, length=200):
    count = defaultdict(int)
    texts = [(key, (text or "").encode()) for key, text in rows]
    for _, data in texts:
        for at in range(len(data) - length + 1):
            count[data[at: at + length]] += 1
    out = []
    for key, data in texts:
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            if count[data[at: at + length]] > 1:
                gone[at: at + length] = b"\1" * length
        kept = bytes(byte for byte, flag in zip(data, gone) if not flag)
        out.append((key, len(data), sum(gone), bytes(gone).replace(b"\0", b" ").split().__len__(), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def cases():
    top = substring.NO_ID if hasattr(substring, "NO_ID") else (1 << 63) - 1
    rows = passages() + [(key + 300 if key is not None else None, text) for key, text in odd_rows()]
    return rows, [(top if key is None else key, text) for key, text in rows]


def test_word_passages_match_brute_force(spark):
    rows, plain = cases()
    got = substring.without_repeats(frame(spark, rows, clashing=True)).collect()
    assert sorted((row.key, row.n_words, row.n_removed, row.kept_sha256) for row in got) == brute_words(plain)
    assert all(hashlib.sha256(row.kept.encode()).hexdigest() == row.kept_sha256 and sum(b - a + 1 for a, b in zip(row.spans[::2], row.spans[1::2])) == row.n_removed for row in got)


@pytest.mark.parametrize("hot", [50_000, 2])
def test_byte_strings_match_brute_force(spark, hot):
    rows, plain = cases()
    got = suffixes.without_repeated_bytes(frame(spark, rows, clashing=True), hot=hot).collect()
    want = brute_bytes(plain)
    assert sorted((row.key, row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) for row in got) == want
    assert sum(row.n_removed for row in got) > 1000


def test_empty_tables(spark):
    assert substring.without_repeats(frame(spark, [])).count() == 0
    assert suffixes.without_repeated_bytes(frame(spark, [])).count() == 0
