"""Language of texts in two steps: first the family, then the languages of that family against each other.

Texts become hashed counts of byte trigrams of lower-cased words with their edges. A linear support vector machine for
each family separates it from all others; within the family chosen, one machine for each pair of its languages
votes. Each machine is trained by dual coordinate descent in a task of its own, on a bounded sample of the
labelled rows; the driver only gathers weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, doc_id, landed, read, row_keys, table

SIZE = 2048
# Labelled rows used for training in all, dealt evenly to the languages; chosen by a hash of the id.
SAMPLE = 3000
EPOCHS = 25
# Widely known families; a language that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic", "hr": "slavic", "sr": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic",
}

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.zeros(256, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of damped and scaled trigram counts for each document."""
    folded = _FOLD[data]
    # Every document gets an edge before and after it.
    places = np.arange(len(data)) + 2 * np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends]))) + 1
    units = np.zeros(len(data) + 2 * len(ends), np.uint32)
    units[places] = folded
    middle = places[folded > 0]
    codes = units[middle - 1] * np.uint32(0x9E3779B1) + units[middle] * np.uint32(0x85EBCA77) + units[middle + 1] * np.uint32(0xC2B2AE3D)
    codes ^= codes >> np.uint32(15)
    codes *= np.uint32(0x2C1B3C6D)
    codes >>= np.uint32(32 - SIZE.bit_length() + 1)
    doc = np.searchsorted(ends + 2 * np.arange(1, len(ends) + 1), middle, "right")
    counts = np.bincount(doc * SIZE + codes, minlength=len(ends) * SIZE).reshape(len(ends), SIZE).astype(np.float32)
    counts = np.sqrt(counts)
    return counts / np.maximum(np.sqrt((counts**2).sum(1, keepdims=True)), 1e-9)


def _vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, ends in chunks(batches):
        yield table({"lang": (batch.column("lang"), None), "vector": ([row.tobytes() for row in grams(data, ends)], pa.binary())})


def trained(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, cost: float = 10.0) -> np.ndarray:
    """Weights of a linear support vector machine (the last is the bias) by dual coordinate descent; ``y`` is 1 or -1.

    Either side has the same total cost, however many rows it has.
    """
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    limit = np.where(y > 0, cost * len(y) / (2 * max((y > 0).sum(), 1)), cost * len(y) / (2 * max((y < 0).sum(), 1)))
    norms, alpha, w = (x**2).sum(1), np.zeros(len(y)), np.zeros(x.shape[1])
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for at in rng.permutation(len(y)):
            step = alpha[at]
            alpha[at] = min(max(step - (y[at] * (x[at] @ w) - 1) / norms[at], 0.0), limit[at])
            if alpha[at] != step:
                w += (alpha[at] - step) * y[at] * x[at]
    return w


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    # Spark gives the rows of a group in any order; the descent shall not depend on it.
    rows = rows.sort_values(["side", "vector"])
    x = np.frombuffer(b"".join(rows["vector"]), np.float32).reshape(len(rows), SIZE)
    return pd.DataFrame({"machine": [rows["machine"].iloc[0]], "weights": [trained(x, rows["side"].to_numpy()).tobytes()]})


@dataclass
class Model:
    """``tree`` has the languages of each family; machines are named family:x and pair:x:y. Grows with the languages only."""

    tree: dict[str, list[str]]
    machines: dict[str, np.ndarray]

    def predicted(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
        chance = lambda machine: 1 / (1 + np.exp(-4 * np.clip(x @ self.machines[machine], -50, 50)))
        families = sorted(self.tree)
        group = np.stack([chance(f"family:{name}") if len(families) > 1 else np.ones(len(x)) for name in families], 1)
        group /= group.sum(1, keepdims=True)
        chosen = group.argmax(1)
        langs, score = np.full(len(x), "", object), np.zeros(len(x))
        for at, name in enumerate(families):
            members = self.tree[name]
            votes = np.zeros((len(x), len(members)))
            for one, two in combinations(range(len(members)), 2):
                here = chance(f"pair:{members[one]}:{members[two]}")
                votes[:, one] += here
                votes[:, two] += 1 - here
            share = votes / max(len(members) - 1, 1) if len(members) > 1 else votes + 1
            mine = chosen == at
            best = share.argmax(1)
            langs[mine] = np.array(members, object)[best[mine]]
            score[mine] = (group[:, at] * share.max(1))[mine]
        return langs, np.clip(score, 0, 1)


def fitted(docs: DataFrame, sample: int = SAMPLE, families: dict[str, str] | None = None) -> Model:
    """Machines from ``docs`` (doc_id, text, lang). Rows with a null or empty text or lang teach nothing.

    The sample takes from each language about ``sample`` / languages of its rows, those with the smallest hashes of their
    id and text, so its size is bounded and it is the same on every run.
    """
    families = FAMILIES if families is None else families
    usable = docs.filter("lang is not null and lang <> '' and text is not null and text <> ''").select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("draw"))
    counts = {row[0]: row[1] for row in usable.groupBy("lang").count().collect()}
    tree: dict[str, list[str]] = {}
    for lang in sorted(counts):
        tree.setdefault(families.get(lang, f"only {lang}"), []).append(lang)
    if len(counts) < 2:
        return Model(tree, {})
    rates = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, float(sample) / len(counts) / n * (1 << 40))])
    drawn = landed(usable.filter(F.col("draw") < rates[F.col("lang")]).select("lang", "text").mapInArrow(_vectors, "lang string, vector binary"), "language-sample")
    sides = []
    for family, members in tree.items():
        if len(tree) > 1:
            sides.append(F.struct(F.lit(f"family:{family}").alias("machine"), F.when(F.col("lang").isin(members), 1.0).otherwise(-1.0).alias("side")))
        for one, two in combinations(members, 2):
            side = F.when(F.col("lang") == one, 1.0).when(F.col("lang") == two, -1.0)
            sides.append(F.when(side.isNotNull(), F.struct(F.lit(f"pair:{one}:{two}").alias("machine"), side.alias("side"))))
    rows = drawn.select("vector", F.explode(F.array(*sides)).alias("of")).filter("of is not null").select("vector", "of.machine", "of.side")
    found = rows.groupBy("machine").applyInPandas(_fit, "machine string, weights binary").collect()
    machines = {row.machine: np.frombuffer(row.weights, np.float64) for row in found}
    for machine in [f"family:{name}" for name in tree] + [f"pair:{a}:{b}" for members in tree.values() for a, b in combinations(members, 2)]:
        machines.setdefault(machine, np.zeros(SIZE + 1))
    return Model(tree, machines)


def _predict(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch, data, ends in chunks(batches):
        edges = np.concatenate([[0], ends])
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            last = first + part.num_rows
            lettered = np.array([bool(_LETTER.search(text)) for text in part.column("text").to_pylist()], bool)
            langs, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
            if len(model.tree) == 1 and sum(map(len, model.tree.values())) == 1:
                langs[lettered], score[lettered] = next(iter(model.tree.values()))[0], 1.0
            elif model.tree and lettered.any():
                found, sure = model.predicted(grams(data[edges[first]: edges[last]], edges[first + 1: last + 1] - edges[first]))
                langs[lettered], score[lettered] = found[lettered], sure[lettered]
            yield table({"key": (part.column("key"), None), "mark": (part.column("mark"), None), "lang_pred": (list(langs), pa.string()), "score": (score, pa.float64())})


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: key, mark, lang_pred, score; ``und`` and 0 where the text is null or has no letter.

    With no language learnt all are ``und``; with one, all are that one. Only texts are read.
    """
    return row_keys(docs).mapInArrow(partial(_predict, model=model), "key bigint, mark binary, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = languages(docs, fitted(docs.filter(~held_out)))
    return found.select(doc_id(), "lang_pred", "score").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
