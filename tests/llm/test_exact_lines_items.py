import hashlib
import re
from collections import Counter, defaultdict

import pytest
from helpers import frame, odd_rows, prose

from tidemark.llm import decontaminate, exact, lines
from tidemark.llm.common import NO_ID


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def exact_rows():
    rows = odd_rows() + [(20 + at, f"Copy of one TEXT {at % 3}".upper() if at % 2 else f"copy of one text {at % 3}") for at in range(60)]
    return rows + [(50, "copy of one text 1"), (90, "Ärger"), (91, "ärger")]


@pytest.mark.parametrize("leaves,fan_in", [(512, 8), (5, 2), (1, 8)])
def test_exact_duplicates(spark, leaves, fan_in):
    rows = exact_rows()
    groups = defaultdict(list)
    for key, text in rows:
        groups[lower(text)].append(NO_ID if key is None else key)
    want = sorted(
        (NO_ID if key is None else key, max(groups[lower(text)]), len(groups[lower(text)]), hashlib.sha256(lower(text).encode()).hexdigest()) for key, text in rows)
    got = exact.exact_duplicates(frame(spark, rows, clashing=True), leaves, fan_in).collect()
    whole = lambda x: NO_ID if x is None else x
    assert sorted((whole(row.doc_id), whole(row.keep_id), row.group_size, row.text_sha256) for row in got) == want
    assert all(row.kept == (row.doc_id == row.keep_id) for row in got)


def test_exact_stage_keeps_one_row_of_each_text(spark):
    docs = frame(spark, exact_rows(), clashing=True)
    out = exact.without_copies(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert sorted(Counter(lower(row.text) for row in kept).values()) == [1] * len({lower(text) for _, text in exact_rows()})
    assert exact.exact_duplicates(frame(spark, [])).count() == exact.without_copies(frame(spark, [])).count() == 0


def brute_lines(rows, min_chars, min_docs):
    blanks = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for key, text in rows:
        for line in (text or "").split("\n"):
            holders[lower(line.strip(blanks))].add(key)
    out = []
    for key, text in rows:
        all_ = (text or "").split("\n")
        kept = [line for line in all_ if (k := lower(line.strip(blanks))) is not None and not (len(k) >= min_chars and len(holders[k]) >= min_docs and key != max(holders[k]))]
        out.append((key, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_lines(spark):
    shared = ["a shared line that is long enough to count é %d" % at for at in range(4)]
    rows = [(NO_ID if key is None else key, text) for key, text in odd_rows()]
    for at in range(40):
        body = [shared[at % 4].upper() if at % 3 else f"\t{shared[at % 4]} \r", f"own line {at}", shared[0], "short", shared[at % 4]]
        rows.append((100 + at, "\n".join(body[: 1 + at % 5]) + "\n" * (at % 2)))
    docs = frame(spark, [(None if key == NO_ID else key, text) for key, text in rows], clashing=True)
    got = lines.without_lines(docs).collect()
    assert sorted((row.key, row.n_lines, row.n_dropped, row.kept_sha256) for row in got) == brute_lines(rows, 40, 5)
    assert lines.without_lines(frame(spark, [])).count() == 0


def test_contained_items(spark):
    words = [prose(at, 60) for at in range(30)]
    items = [(at, " ".join(words[at][: 4 + 2 * at])) for at in range(25)] + [(30, None), (31, ""), (None, " ".join(words[3])), (7, "another text under id seven here"), (32, " ".join(words[20][:44]))]
    rows = odd_rows()
    for at in range(60):
        own, item = prose(1000 + at, 50 if at % 7 else 4000, 3000), words[at % 25][: 4 + 2 * (at % 25)]
        item = [word if at % 4 or place % 30 else "changed" for place, word in enumerate(item)]
        rows.append((100 + at, " ".join(own[:20] + item + own[20:]).upper() if at % 5 == 0 else "\n".join(own[:9] + item + own[9:])))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contained_items(frame(spark, rows, clashing=True), table).collect()

    def shingles(text):
        split = re.findall("[^\x20\x09-\x0D]+", lower(text))
        return {tuple(split[at: at + 5]) for at in range(len(split) - 4)}

    of_item, of_doc = defaultdict(set), defaultdict(set)
    for item, text in items:
        if item is not None:
            of_item[item] |= shingles(text)
    for key, text in rows:
        of_doc[NO_ID if key is None else key] |= shingles(text)
    want = {(key, item): (len(two), len(one & two)) for key, one in of_doc.items() for item, two in of_item.items() if two and len(one & two) >= 0.8 * len(two) - 1e-9}
    assert {(row.key, row.item_id): (row.n_item_shingles, row.n_shared) for row in got} == want and len(want) > 20
    docs = frame(spark, rows, clashing=True)
    assert sorted(str(row.doc_id) for row in decontaminate.without_items(docs, table).collect()) == sorted(str(key) for key, _ in rows if key is None or key not in {key for key, _ in want})
    assert decontaminate.contained_items(frame(spark, []), table).count() == decontaminate.contained_items(docs, table.limit(0)).count() == 0
