"""Repeated windows of units (words or bytes), found by way of anchors; shared by the two window operators.

1. Every document names its windows by anchors (see ``windows``). Anchors whose seed stands nowhere else are
   dropped: their windows cannot be repeated.
2. The windows of one anchor form its segment. Segments with the same digest are one, so the inside of a passage
   is settled here, however many documents hold it.
3. Only seeds with several different segments are left: the edges of passages and the places where
   copies differ. One holder of each such segment is looked up for its content, and the operators compare
   single windows there.
4. What is covered goes back to the documents as runs of windows.

A row of ``hits`` is one anchor: seed and seg (64-bit digests of different families; the digest of a segment
only counts within its seed), key and mark (the document), at = first window * 256 + number of windows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, landed, table, words
from .windows import Rolling, anchors, byte_units, word_units

ROWS = "seed bigint, seg bigint, key bigint, mark binary, at bigint"
HIT = ("seed", "seg", "key", "mark", "at")


class Units:
    """The units of a stretch of documents with their hashes of two families."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, of_words: bool) -> None:
        self.starts = None
        if of_words:
            self.starts, sizes, ends = words(data, ends)
            first, second = word_units(data, self.starts, sizes, 1, 2)
        else:
            first, second = byte_units(data, 1), byte_units(data, 2)
        self.ends = ends
        self.one, self.two = Rolling(first, 3), Rolling(second, 4)

    def anchors(self, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(seed digest, segment digest, place, first window, windows) of every anchor."""
        if not len(self.ends) or self.ends[-1] < length:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none.astype(np.uint64), none, none, none
        seeds = self.one.every(seed)
        place, first, last = anchors(seeds, self.ends, length, seed)
        offset = (place - first).astype(np.uint64)
        return seeds[place], self.two.at(first, last - first + length) + offset, place, first, last - first + 1


def _rows(batches: Iterable[pa.RecordBatch], length: int, seed: int, of_words: bool) -> Iterator[pa.RecordBatch]:
    for batch, data, ends in chunks(batches):
        units = Units(data, ends, of_words)
        seeds, segs, _, first, n = units.anchors(length, seed)
        doc = np.searchsorted(units.ends, first, "right")
        began = np.concatenate([[0], units.ends[:-1]])
        yield table({
            "seed": (seeds.view(np.int64), pa.int64()), "seg": (segs.view(np.int64), pa.int64()), "key": (batch.column("key").take(pa.array(doc)), None),
            "mark": (batch.column("mark").take(pa.array(doc)), None), "at": ((first - began[doc]) * 256 + n, pa.int64()),
        })


def hits(docs: DataFrame, length: int, seed: int, of_words: bool, repeated) -> DataFrame:
    """The anchors whose seed is ``repeated`` (a condition on the rows of one seed), landed, each with ``copies``.

    Rows that repeat id and text have the same anchors; they are one here, however many they are, so no document takes part in its own copies' work.
    """
    rows = docs.mapInArrow(partial(_rows, length=length, seed=seed, of_words=of_words), ROWS)
    seeds = landed(rows.groupBy("seed").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count(F.lit(1)).alias("n")).filter(repeated).select("seed"), "seeds")
    return landed(rows.join(seeds, "seed", "left_semi").groupBy(*HIT).agg(F.count(F.lit(1)).alias("copies")), "hits")


def several(segments: DataFrame) -> DataFrame:
    """(seed, segs) of seeds that have several different segments, landed."""
    return landed(segments.groupBy("seed").agg(F.count(F.lit(1)).alias("segs")).filter("segs > 1"), "open-seeds")


def looked_up(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents that hold ``wanted`` anchors (key, mark, at, others), each with the list of its anchors."""
    lists = wanted.groupBy("key", "mark").agg(F.collect_list(F.struct(*[name for name in wanted.columns if name not in ("key", "mark")])).alias("wanted"))
    return docs.join(lists, ["key", "mark"])


def spans(covers: DataFrame) -> DataFrame:
    """(key, mark, spans) from covered anchors (key, mark, at, runs); null runs: all windows of the anchor."""
    return covers.groupBy("key", "mark").agg(F.collect_list(F.struct("at", "runs")).alias("spans"))


def covered_units(n: int, found: pa.Array, length: int) -> np.ndarray:
    """Which of a document's ``n`` units lie in a covered window; ``found`` is its list of (at, runs)."""
    marks = np.zeros(n + 1, np.int64)
    if found is not None and len(found):
        at = found.field("at").to_numpy(zero_copy_only=False)
        runs = found.field("runs")
        whole = runs.is_null().to_numpy(zero_copy_only=False)
        first, many = at >> 8, at & 255
        lows, highs = [first[whole]], [first[whole] + many[whole] - 1 + length]
        for place in np.flatnonzero(~whole):
            pairs = np.asarray(runs[int(place)].as_py(), np.int64).reshape(-1, 2) + first[place]
            lows.append(pairs[:, 0])
            highs.append(pairs[:, 1] + length)
        np.add.at(marks, np.concatenate(lows), 1)
        np.subtract.at(marks, np.concatenate(highs), 1)
    return np.cumsum(marks[:-1]) > 0


def runs_of(flags: np.ndarray) -> list[int]:
    """[first, last, first, last, ...] of the runs of true flags."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1], 1).ravel().tolist()
