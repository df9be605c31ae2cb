import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import repair
from tidemark.llm.repair import repaired

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WORDS = ["yes.", "no!", "cut off", "", " \t", "what?", None]


def brute(turns):
    """Report and repaired lines of one conversation, from a table of cheapest (cost, audit, lines) per state, one turn at a time."""
    rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for t, r, x in turns))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("b" if not re.search(r"[^\x20\x09-\x0D]", text) else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    def better(table, state, entry):
        if state not in table or entry < table[state]:
            table[state] = entry

    def inserted(table):
        for _ in range(2):
            for state, (cost, audit, lines) in list(table.items()):
                to = "a" if state == "u" else "u"
                better(table, to, (cost + 2, audit + "I", (*lines, ("user:" if to == "u" else "assistant:"))))

    table = {"z": (0, "", ())}
    for (_, _, role, text), fault in zip(rows, faults):
        inserted(table)
        new = {}
        for state, (cost, audit, lines) in table.items():
            better(new, state, (cost + 3, audit + "D", lines))
            if fault in ("b", "d"):
                continue
            extra, to = int(fault == "t"), "a" if state == "u" else "u"
            better(new, to, (cost + 2 + extra, audit + "R", (*lines, f"{'user' if to == 'u' else 'assistant'}:{text}")))
            if role[:1] == to or (role[:1] == "s" and state == "z"):
                better(new, "s" if role[:1] == "s" else to, (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
        table = new
    inserted(table)
    cost, audit, lines = min(table[state] for state in "za" if state in table)
    known = [t for t, _, _ in turns if t is not None]
    pairs = [rows[at][2][:1] + rows[at + 1][2][:1] for at in range(len(rows) - 1)]
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count("b"), faults.count("d"), faults.count("t"), sum(pair not in ("su", "ua", "au") for pair in pairs),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest() if lines else None)


def got(spark, rows, **options):
    report, mended = repaired(spark.createDataFrame(rows, SCHEMA), **options)
    digests = {row.conv_id: row.repaired_sha256 for row in repair.digested(mended).collect()}
    return {row.conv_id: (*row[1:], digests.get(row.conv_id)) for row in report.collect()}


def conversations(seed, many, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(many):
        for at in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([at, at, at, at + 1, None]), role, rng.choice(WORDS)))
    return rows


def by_conversation(rows):
    found = {}
    for conv, *turn in rows:
        found.setdefault(conv, []).append(tuple(turn))
    return found


def test_repairs_match_brute_force(spark):
    rows = conversations(1, 150, 12) + [(None, 1, "user", "hi."), (None, 2, "assistant", "there."), (None, 2, "assistant", "there.")]
    assert got(spark, rows) == {conv: brute(turns) for conv, turns in by_conversation(rows).items()}


@pytest.mark.parametrize("cell, fan_in", [(3, 2), (7, 3)])
def test_long_conversations_are_composed_of_cells(spark, monkeypatch, cell, fan_in):
    monkeypatch.setattr(repair, "FAN_IN", fan_in)
    rows = conversations(2, 6, 90) + [(99, at, "user", f"{at}.") for at in range(60)]
    assert got(spark, rows, cell=cell) == {conv: brute(turns) for conv, turns in by_conversation(rows).items()}


def test_block_table_is_the_composition_of_single_turns():
    vectors, single, block = repair.tables()
    assert block.shape == (len(vectors), repair.SYMBOLS**repair.BLOCK) and len(vectors) < 64
    for number in random.Random(3).sample(range(block.shape[1]), 300):
        at = np.arange(len(vectors))
        for symbol in reversed(repair._digits(number)):
            at = single[at, symbol]
        assert (block[:, number] == at).all()


def test_damage_follows_the_checksum(spark):
    rows = [(conv, turn, "assistant", "One. Two!") for conv in (1, 2, None) for turn in [*range(40), None]]
    expected = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: "One Two"}.get(kind, text)
        expected += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    found = [tuple(row) for row in repair.damaged(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_empty_table_and_clashing_columns(spark):
    assert got(spark, []) == {}
    rows = [(1, 0, "user", "a.", "x", "y"), (1, 1, "assistant", "b.", "x", "y")]
    report, mended = repaired(spark.createDataFrame(rows, SCHEMA + ", at string, code string"))
    assert [row.audit for row in report.collect()] == ["KK"] and mended.count() == 2
