import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import frame, odd_rows, prose
from pyspark.sql import functions as F

from tidemark.llm import chat, packing
from tidemark.llm.common import NO_ID

public_tokenizers = pytest.importorskip("public_tokenizers")


def texts():
    odd = ["It's we'll DON'T", "a\x1cb c\x1fd", "İstanbul ΣΑΣ ς é Å", "<|endoftext|> x<|startoftext|>y", "  z　\u0085q", "1234 5.6 !!'s ''ll"]
    return odd_rows() + [(100 + at, text) for at, text in enumerate(odd)] + [(200 + at, " ".join(prose(at, 10 + 150 * at))) for at in range(40)]


def test_pieces_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = texts()
    want = []
    for key, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for start in range(0, len(ids), 4096):
            part = np.array(ids[start: start + 4096], "<u4")
            want.append((NO_ID if key is None else key, start // 4096, start, len(part), zlib.crc32(part.tobytes())))
    placed = packing.packed_documents(frame(spark, rows, clashing=True))
    got = placed.collect()
    assert sorted((row.key, row.piece, row.start, row.length, row.ids_crc32) for row in got) == sorted(want)
    assert all(zlib.crc32(np.array(row.ids, "<u4").tobytes()) == row.ids_crc32 for row in got)
    whole = {row.sequence_id: row.ids for row in packing.sequences(placed).collect()}
    assert all(whole[row.sequence_id][row.offset: row.offset + row.length] == row.ids for row in got)


def gapless(rows, limit):
    bins = defaultdict(list)
    for sequence, offset, size in rows:
        bins[sequence].append((offset, size))
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= limit
    return len(bins)


@pytest.mark.parametrize("block,fan_in", [(16_384, 8), (40, 2), (64, 8)])
def test_packing_is_gapless_and_tight(spark, block, fan_in):
    rng = np.random.default_rng(block)
    sizes = np.minimum(4096, rng.lognormal(5.5, 1.2, 900).astype(int) + 1).tolist() + [4096] * 20 + [2100] * 30
    items = spark.createDataFrame(list(enumerate(sizes)), "item bigint, size bigint")
    placed = {row.item: row for row in packing.packed(items, block=block, fan_in=fan_in).collect()}
    assert sorted(placed) == list(range(len(sizes)))
    used = gapless([(placed[at].sequence_id, placed[at].offset, size) for at, size in enumerate(sizes)], 4096)
    assert used <= 1.03 * sum(sizes) / 4096 + 8


def test_empty_table_packs_to_nothing(spark):
    assert packing.packed_documents(frame(spark, [])).count() == 0


def brute_chats(rows):
    turns = defaultdict(set)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].add(((turn is not None, turn or 0), role or "", text or ""))
    lists = {conv: [(role, text) for _, role, text in sorted(some)] for conv, some in turns.items()}
    out = []
    for conv, one in lists.items():
        same = [other for other, two in lists.items() if two == one]
        if conv == min(same) and not any(len(two) > len(one) and two[: len(one)] == one for two in lists.values()):
            out.append((conv, len(one), len(same), "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in one)))
    return sorted(out)


def test_chats_match_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(None, 0, "user", "nobody's"), (1, None, "user", "no number"), (1, 0, None, None), (2, 0, "user", ""), (2, 0, "user", ""), (3, 0, "user", "")]
    for base in range(25):
        log = [("user" if at % 2 == 0 else "assistant", "hello" if at == 0 else f"words {base % 20} {at}") for at in range(rng.integers(1, 9))]
        for _ in range(rng.integers(1, 5)):
            conv = 10 + len(rows)
            rows += [(conv, at, *turn) for at, turn in enumerate(log[: rng.integers(1, len(log) + 1)])]
    rng.shuffle(rows)
    rows = [(None if c is None else int(c), None if t is None else int(t), r, x) for c, t, r, x in rows]
    table = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("place", F.lit("clash")).withColumn("n_turns", F.lit(0))
    got = chat.rendered(table).collect()
    assert sorted((row.conv_id, row.n_turns, row.n_copies, row.chat) for row in got) == brute_chats(rows)
    assert chat.rendered(table.limit(0)).count() == 0
