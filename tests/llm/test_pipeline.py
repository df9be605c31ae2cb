import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import frame, near_rows, odd_rows, prose
from test_near import brute as near_brute
from test_packing_chat import gapless

import corpus_pipeline
from tidemark.llm import quality

public_tokenizers = pytest.importorskip("public_tokenizers")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    words = re.findall("[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[at: at + 5]) for at in range(len(words) - 4)}


def test_pipeline_matches_brute_force(spark, tmp_path):
    items = [(at, " ".join(prose(500 + at, 30))) for at in range(5)]
    rows = [(key, text) for key, text in odd_rows() if key not in (4, None)] + [(10 + key, text) for key, text in near_rows(3)]
    rows += [(300 + at, "!! ##".join(["JUNK"] * (20 + at)) + f" {at}") for at in range(12)]
    rows += [(400 + at, " ".join(prose(at, 40)) + " " + items[at % 5][1]) for at in range(6)] + [(450, rows[20][1].upper()), (451, rows[21][1])]
    labels = [(key, 0 if 300 <= key < 312 else 1, 0) for key, _ in rows if key >= 10]
    docs = frame(spark, rows)
    for name, table in (("documents", docs), ("benchmark", spark.createDataFrame(items, "item_id bigint, text string")), ("labels", spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")

    scores = {row.key: row.score for row in quality.quality_scores(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    kept = [(key, text) for key, text in rows if scores[key] >= 0.5]
    assert 0 < len(rows) - len(kept) and not any(300 <= key < 312 for key, _ in kept)
    last = {}
    for key, text in kept:
        last[lower(text)] = max(key, last.get(lower(text), key))
    kept = [(key, text) for key, text in kept if last[lower(text)] == key]
    top, _ = near_brute(kept, 5, 80)
    kept = [(key, text) for key, text in kept if top[key] == key]
    tests = [shingles(text) for _, text in items]
    kept = [(key, text) for key, text in kept if not any(len(one & shingles(text)) >= 0.8 * len(one) for one in tests)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = defaultdict(int)
    for key, text in kept:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for start in range(0, len(ids), 4096):
            want[key, start // 4096, start, zlib.crc32(np.array(ids[start: start + 4096], "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(row.doc_id, row.piece, row.start, row.ids_crc32): 1 for row in got} == dict(want)
    gapless([(row.sequence_id, row.offset, row.length) for row in got], 4096)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = frame(spark, odd_rows(), clashing=True)
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() > 0
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()
