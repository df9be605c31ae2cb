"""Rows that repeat an id or have none: each different text counts on its own."""

import re

import pytest
from helpers import frame, near_rows, odd_rows, prose
from test_near import brute

import corpus_pipeline
from tidemark.llm import decontaminate, near
from tidemark.llm.common import NO_ID


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    words = re.findall("[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[at: at + 5]) for at in range(len(words) - 4)}


def repeated_ids():
    """Rows that share an id or have none, each with a text of its own; some texts are near a document's, or near each other."""
    far, real, twin = (prose(seed, 60) for seed in (901, 902, 903))
    near_real, near_twin = real[:-1] + ["else"], twin[:-1] + ["else"]
    rows = [(None, " ".join(prose(910 + at, 40))) for at in range(6)] + [(700, " ".join(real)), (None, " ".join(near_real))]
    return rows + [(None, " ".join(twin)), (None, " ".join(near_twin)), (701, " ".join(far)), (702, " ".join(real[:-2] + ["other", "end"])), (702, " ".join(prose(904, 60))), (702, "")]


def brute_texts(rows, width, percent):
    """(key, text) -> (smallest key of its component, whether it is a possible keeper), where each different text is a node."""
    nodes = sorted({(NO_ID if key is None else key, text or "") for key, text in rows})
    tops, _ = brute([(at, text) for at, (_, text) in enumerate(nodes)], width, percent)
    return {node: nodes[tops[at]][0] for at, node in enumerate(nodes)}, [tops[at] for at in range(len(nodes))]


def test_texts_that_share_an_id_are_linked_each_on_its_own(spark):
    rows = repeated_ids() + near_rows()
    want, tops = brute_texts(rows, 2, 80)
    got = near.near_duplicates(frame(spark, rows), 2, 80).collect()
    assert sorted((row.key, row.component) for row in got) == sorted((key, component) for (key, _), component in want.items())
    assert sum(row.kept for row in got) == len(set(tops))


def test_stage_keeps_one_text_of_each_group(spark):
    rows = repeated_ids() + near_rows()
    want, tops = brute_texts(rows, 5, 80)
    out = [(NO_ID if row.doc_id is None else row.doc_id, row.text) for row in near.without_near_copies(frame(spark, rows)).collect()]
    assert len(out) == len(set(out)) == len(set(tops))
    assert {key for key, _ in out} == {key for (key, _), component in want.items() if key == component}
    assert {text for key, text in rows[:6]} <= {text for _, text in out}


def test_pipeline_keeps_texts_that_share_an_id_or_have_none(spark, tmp_path):
    items = [(at, " ".join(prose(500 + at, 30))) for at in range(3)]
    pytest.importorskip("public_tokenizers")
    rows = odd_rows() + repeated_ids() + [(10 + key, text) for key, text in near_rows(3)]
    rows += [(key, " ".join(prose(at, 40)) + " " + items[at % 3][1]) for at, key in enumerate((None, 800, 801))] + [(800, "a clean text under an id that also holds an item")]
    docs = frame(spark, rows)
    for name, table in (("documents", docs), ("benchmark", spark.createDataFrame(items, "item_id bigint, text string")), ("labels", spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    last = {}
    for key, text in ((NO_ID if key is None else key, text) for key, text in rows):
        last[lower(text)] = max((key, text or ""), last.get(lower(text), (key, text or "")))
    kept = sorted(set(last.values()))
    top, _ = brute([(at, text) for at, (_, text) in enumerate(kept)], 5, 80)
    tests = [shingles(text) for _, text in items]
    want, held = set(), 0
    for group in {at: [other for other in top if top[other] == at] for at in set(top.values())}.values():
        # Of texts that share the smallest id any may stay; here all of these are clean or none is.
        key = min(kept[at][0] for at in group)
        clean = {not any(len(one & shingles(kept[at][1])) >= 0.8 * len(one) for one in tests) for at in group if kept[at][0] == key}
        assert len(clean) == 1
        held += clean == {True}
        if clean == {True}:
            want.add(key)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    first = [NO_ID if row.doc_id is None else row.doc_id for row in got if row.piece == 0]
    assert len(first) == held and set(first) == want


def test_items_are_looked_for_in_each_text(spark):
    item = " ".join(prose(500, 30))
    rows = [(None, "start " + item), (None, "a clean text of some more words"), (800, item + " end"), (800, "one more clean text of some words")]
    table = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert {row.text for row in decontaminate.without_items(frame(spark, rows), table).collect()} == {rows[1][1], rows[3][1]}
