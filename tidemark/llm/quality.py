"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

Each text becomes a short row of statistics. Cosines of random projections of the standardised row (seeded, so
that every task draws the same) approximate a Gaussian kernel, so a linear fit in them is a smooth fit in the
statistics. The fit needs only sums over the labelled rows, the normal equations, which every partition adds up for
itself and Spark adds over partitions, cell by cell; the driver solves one system whose size is a
parameter. The rows are in two folds; each fold is scored by the fit to the other, and those scores are
turned to probabilities by pool-adjacent-violators over a bounded number of score cells.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, doc_id, landed, read, row_keys, table, words
from .windows import mixed, word_units

FEATURES = 128
WIDTH = 1.0
RIDGE = 1e-3
CELLS = 2000
STATISTICS = (
    "size", "words", "word_length", "word_spread", "upper", "lower", "digit", "blank", "line", "sentence_mark", "other_mark", "beyond_ascii", "distinct",
    "same_as_last", "same_pair", "capital_words", "all_capital_words", "marked_words", "lone_marks", "vowel", "line_length", "long_words",
)


def _byte_class(members: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(members.encode())] = 1
    return out


_UPPER, _DIGIT = _byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _byte_class("0123456789")
_LOWER = _byte_class("abcdefghijklmnopqrstuvwxyz")
_SENTENCE = _byte_class(".,;:?'\"-()")
_BLANKS = _byte_class(" \t\n\x0b\x0c\r")
_OTHER = np.zeros(256, np.uint8)
_OTHER[33:127] = 1 - np.maximum.reduce([_UPPER, _DIGIT, _LOWER, _SENTENCE])[33:127]
_BEYOND = (np.arange(256) >= 128).astype(np.uint8)
_LINE = _byte_class("\n")


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each document; empty documents have 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def statistics(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each document."""
    n = np.diff(np.concatenate([[0], ends])).astype(np.float64)
    size = np.maximum(n, 1)
    starts, lengths, closes = words(data, ends)
    many = np.diff(np.concatenate([[0], closes])).astype(np.float64)
    some = np.maximum(many, 1)
    count = {name: _sums(kind[data], ends) for name, kind in (
        ("upper", _UPPER), ("lower", _LOWER), ("digit", _DIGIT), ("blank", _BLANKS), ("line", _LINE), ("sentence", _SENTENCE), ("other", _OTHER), ("beyond", _BEYOND), ("vowel", _byte_class("aeiou")))}
    hashes = word_units(data, starts, lengths, 1)[0]
    doc = np.repeat(np.arange(len(ends)), many.astype(np.int64))
    same_doc = doc[1:] == doc[:-1]
    repeat = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & same_doc]) if len(hashes) else np.zeros(0, bool)
    pairs = mixed(hashes[1:] * np.uint64(3) + hashes[:-1])[same_doc] if len(hashes) else hashes
    owner = doc[1:][same_doc] if len(hashes) else doc

    def different(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort([values, of])
        values, of = values[order], of[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
        return np.bincount(of[new], minlength=len(ends)).astype(np.float64)

    uppers, letters, marks = (np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)]) for kind in (_UPPER, np.maximum.reduce([_UPPER, _LOWER, _BEYOND]), _OTHER))
    within = lambda total: total[starts + lengths] - total[starts]
    in_upper, in_letter, in_mark = within(uppers), within(letters), within(marks)
    mean = _sums(lengths, closes) / some
    spread = np.sqrt(np.maximum(_sums(lengths.astype(np.float64) ** 2, closes) / some - mean**2, 0))
    out = np.stack([
        np.log1p(n), np.log1p(many), mean, np.minimum(spread, 20), count["upper"] / size, count["lower"] / size, count["digit"] / size, count["blank"] / size,
        count["line"] / size, count["sentence"] / size, count["other"] / size, count["beyond"] / size, different(hashes, doc) / some, _sums(repeat, closes) / some,
        1 - different(pairs, owner) / np.maximum(many - 1, 1), _sums((in_upper > 0) & (in_upper < in_letter), closes) / some,
        _sums((in_upper > 1) & (in_upper == in_letter), closes) / some, _sums((in_mark > 0) & (in_letter > 0), closes) / some, _sums((in_mark > 0) & (in_letter == 0), closes) / some,
        count["vowel"] / size, np.log1p(n / (count["line"] + 1)), _sums(lengths > 12, closes) / some,
    ], 1)
    out[n == 0] = 0
    return out


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, ends in chunks(batches):
        yield table({"key": (batch.column("key"), None), "mark": (batch.column("mark"), None), "stats": (list(statistics(data, ends)), pa.list_(pa.float64()))})


def measured(docs: DataFrame) -> DataFrame:
    """(key, mark, stats) of every row, as a landed table."""
    return landed(row_keys(docs).mapInArrow(_measure, "key bigint, mark binary, stats array<double>"), "statistics")


@dataclass
class Model:
    """Everything a task needs to score; its size depends on FEATURES and CELLS only."""

    mean: np.ndarray
    scale: np.ndarray
    seed: int
    features: int
    weights: np.ndarray | None = None
    points: np.ndarray | None = None
    values: np.ndarray | None = None

    def lifted(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        directions = rng.normal(size=(len(self.mean), self.features)) * WIDTH / np.sqrt(len(self.mean))
        phase = rng.uniform(0, 2 * np.pi, self.features)
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(x), 1)), np.sqrt(2 / self.features) * np.cos(x @ directions + phase)], 1)

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.lifted(stats) @ self.weights, self.points, self.values), 0, 1)


def held_out(fold: int = 1) -> Column:
    """Rows whose label is never learnt from: crc32 of the id as text, modulo 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == fold, F.lit(False))


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _equations(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """The normal equations of a partition by fold, as (fold, cell, value)."""
    size = model.features + 1
    sums = np.zeros((2, size, size + 1))
    for batch in batches:
        if batch.num_rows:
            x, y, fold = model.lifted(_stack(batch.column("stats"))), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for at in (0, 1):
                mine = x[fold == at]
                sums[at, :, :size] += mine.T @ mine
                sums[at, :, size] += mine.T @ y[fold == at]
    for at in (0, 1):
        if sums[at].any():
            yield table({"fold": (np.full(sums[at].size, at), pa.int32()), "cell": (np.arange(sums[at].size), pa.int32()), "value": (sums[at].ravel(), pa.float64())})


def _crossed(batches: Iterable[pa.RecordBatch], model: Model, fits: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, fold = model.lifted(_stack(batch.column("stats"))), batch.column("fold").to_numpy()
            raw = np.where(fold == 0, x @ fits[1], x @ fits[0])
            cell = np.clip((raw + 1) / 3 * CELLS, 0, CELLS - 1).astype(np.int64)
            yield table({"cell": (cell, pa.int64()), "raw": (raw, pa.float64()), "label": (batch.column("label"), None)})


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values``, by pooling neighbours that violate the order."""
    means: list[float] = []
    sizes: list[float] = []
    spans: list[int] = []
    for value, weight in zip(values, weights):
        means.append(float(value))
        sizes.append(float(weight))
        spans.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            size = sizes[-2] + sizes[-1]
            means[-2:] = [(means[-2] * sizes[-2] + means[-1] * sizes[-1]) / size]
            sizes[-2:], spans[-2:] = [size], [spans[-2] + spans[-1]]
    return np.repeat(means, spans)


def fitted(stats: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = 17) -> Model:
    """A model from all labelled rows of ``stats`` that are not held out; without any, scores are 0.5."""
    known = labels.filter("doc_id is not null and quality is not null").select("doc_id", F.when(F.col("quality") > 0, 1.0).otherwise(0.0).alias("label"))
    known = known.filter(~held_out()).select(F.col("doc_id").cast("bigint").alias("key"), "label", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold"))
    rows = landed(stats.join(known, "key").select("stats", "label", "fold"), "labelled")
    width = len(STATISTICS)
    moments = rows.select(*[F.get("stats", F.lit(at)).alias(f"s{at}") for at in range(width)]).agg(
        F.count(F.lit(1)), *[F.avg(f"s{at}") for at in range(width)], *[F.stddev_pop(f"s{at}") for at in range(width)]).first()
    if not moments[0]:
        return Model(np.zeros(width), np.ones(width), seed, features)
    scale = np.array(moments[1 + width:], float)
    model = Model(np.array(moments[1: 1 + width], float), np.where(scale > 1e-9, scale, 1.0), seed, features)
    size = features + 1
    sums = np.zeros((2, size * (size + 1)))
    for fold, cell, value in rows.mapInArrow(partial(_equations, model=model), "fold int, cell int, value double").groupBy("fold", "cell").agg(F.sum("value")).collect():
        sums[fold, cell] = value
    grams = sums.reshape(2, size, size + 1)

    def solved(gram: np.ndarray) -> np.ndarray:
        penalty = ridge * max(gram[0, 0], 1.0) * np.eye(size)
        penalty[0, 0] = 1e-9
        return np.linalg.solve(gram[:, :size] + penalty, gram[:, size])

    fits = [solved(gram) if gram[0, 0] else None for gram in grams]
    model.weights = solved(grams.sum(0))
    fits = [model.weights if fit is None else fit for fit in fits]
    cells = sorted(rows.mapInArrow(partial(_crossed, model=model, fits=fits), "cell bigint, raw double, label double").groupBy("cell").agg(
        F.avg("raw"), F.avg("label"), F.count(F.lit(1))).collect())
    model.points = np.maximum.accumulate(np.array([row[1] for row in cells]))
    model.values = isotonic(np.array([row[2] for row in cells]), np.array([row[3] for row in cells]))
    return model


def _score(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield table({"key": (batch.column("key"), None), "mark": (batch.column("mark"), None), "score": (model.scores(_stack(batch.column("stats"))), pa.float64())})


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: key, mark, score (0 to 1, the calibrated chance of label 1).

    Only texts enter a score. Null and empty texts have a score as well, that of statistics of zero. Rows that repeat an id
    share its label; a label of a null id is ignored. Without labels every score is 0.5. Other columns are not read.
    """
    stats = measured(docs)
    return stats.mapInArrow(partial(_score, model=fitted(stats, labels)), "key bigint, mark binary, score double")


def _accepted(batches: Iterable[pa.RecordBatch], model: Model, text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            texts = batch.column(text).fill_null("")
            one = pa.RecordBatch.from_arrays([texts], names=["text"])
            score = np.concatenate([model.scores(statistics(data, ends)) for _, data, ends in chunks([one])])
            yield batch.filter(pa.array(score >= 0.5))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of at least 0.5, with their columns unchanged."""
    model = fitted(measured(docs), labels)
    return docs.mapInArrow(partial(_accepted, model=model, text=docs.columns.index("text")), docs.schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select(doc_id(), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
