"""Repeated byte strings by sorted suffixes.

A 200-byte string is the leading part of the suffix that starts at its first byte; it is repeated when the suffix
next to it in sorted order begins with the same 200 bytes. Sorting every suffix of a corpus would move 200 bytes
for each byte of text, so suffixes are sorted only where that is needed: in places whose anchor (see
``anchored``) stands elsewhere too but with other surroundings. Those stretches of text are range-partitioned by
their leading tokens, the first bytes of the anchor, with splitters that Spark samples. A bucket then sorts all
the suffixes that its stretches hold by multikey quicksort: by the first token, and within equal ones by
the next. Equal strings have the same anchor and so meet in one bucket, which makes comparing across a boundary
needless but in one case: an anchor with more than ``HOT`` different surroundings would overfill its bucket. Its
suffixes are dealt out by their digests instead and counted across all buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchored import Units, covered_units, hits, looked_up, runs_of, several, spans
from .common import chunks, discarded, doc_id, landed, read, row_keys, table
from .windows import Rolling, byte_units

LENGTH = 200
SEED = 100
HOT = 1_000
LEAD = 16
# Stretches sorted by one round of array operations, and as many as complete a group.
PIECE = 2_048
STRETCH = "seed bigint, seg bigint, lead binary, ahead int, windows int, content binary"
OUT = "key bigint, mark binary, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _stretches(batches: Iterable[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The content of every wanted segment and how many bytes of it lie ahead of its anchor."""
    for batch, data, ends in chunks(batches):
        _, _, place, first, _ = Units(data, ends, False).anchors(length, seed)
        anchor = dict(zip(first.tolist(), place.tolist()))
        began = np.concatenate([[0], ends[:-1]])
        lists = batch.column("wanted")
        doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        flat = lists.flatten()
        at = flat.field("at").to_numpy()
        start = began[doc] + (at >> 8)
        many = at & 255
        ahead = np.array([anchor[x] for x in start.tolist()], np.int64) - start
        raw = data.tobytes()
        yield table({
            "seed": (flat.field("seed"), None), "seg": (flat.field("seg"), None),
            "lead": ([raw[x: x + LEAD] for x in (start + ahead).tolist()], pa.binary()), "ahead": (ahead, pa.int32()), "windows": (many, pa.int32()),
            "content": ([raw[x: x + n + length - 1] for x, n in zip(start.tolist(), many.tolist())], pa.binary()),
        })


def _groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows in pieces that hold whole groups of ``key``, by which they are sorted."""
    held: list[pa.RecordBatch] = []
    for batch in (batch.slice(first, PIECE) for batch in batches for first in range(0, batch.num_rows, PIECE)):
        if not batch.num_rows:
            continue
        held.append(batch)
        values = batch.column(key).to_numpy()
        cuts = np.flatnonzero(values != values[-1])
        if len(cuts):
            whole = pa.Table.from_batches(held)
            n = whole.num_rows - batch.num_rows + int(cuts[-1]) + 1
            yield whole.slice(0, n).combine_chunks()
            held = whole.slice(n).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Suffixes:
    """All suffixes that the stretches of a piece hold: their row, place in it, and tokens."""

    def __init__(self, rows: pa.Table, length: int) -> None:
        contents = rows.column("content").to_pylist()
        self.many = rows.column("windows").to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(contents), np.uint8)
        began = np.cumsum([0] + [len(x) for x in contents[:-1]])
        self.row = np.repeat(np.arange(len(contents)), self.many)
        self.nth = np.arange(len(self.row)) - np.repeat(np.cumsum(self.many) - self.many, self.many)
        self.start = began[self.row] + self.nth
        self.offset = rows.column("ahead").to_numpy().astype(np.int64)[self.row] - self.nth
        self._length, self._data = length, data

    def token(self, depth: int) -> np.ndarray:
        """The first eight bytes in order, then two digests that stand for all the bytes of the string."""
        if depth == 0:
            out = np.zeros(len(self.start), np.uint64)
            for step in range(8):
                out = (out << np.uint64(8)) | self._data[self.start + step].astype(np.uint64)
            return out
        return Rolling(byte_units(self._data, depth), depth + 4).at(self.start, self._length)


def repeated(groups: np.ndarray, suffixes: Suffixes) -> np.ndarray:
    """Which suffixes have an equal neighbour in sorted order, by multikey quicksort within ``groups``.

    Runs of equal tokens are sorted again by the next token; suffixes that are alone are settled and leave.
    """
    alive = np.arange(len(groups))
    run = groups
    for depth in range(3):
        token = suffixes.token(depth)[alive]
        order = np.lexsort([token, run])
        alive, run, token = alive[order], run[order], token[order]
        new = np.ones(len(alive), bool)
        new[1:] = (run[1:] != run[:-1]) | (token[1:] != token[:-1])
        run = np.cumsum(new)
        alone = new & np.concatenate([new[1:], [True]])
        alive, run = alive[~alone], run[~alone]
        if not len(alive):
            break
    out = np.zeros(len(groups), bool)
    out[alive] = True
    return out


def _sorted(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(seed, seg, runs) of the segments of a bucket that hold repeated strings."""
    for rows in _groups(batches, "seed"):
        suffixes = Suffixes(rows, length)
        seed = rows.column("seed").to_numpy()
        group = np.cumsum(np.concatenate([[0], seed[1:] != seed[:-1]]))
        flags = repeated(group[suffixes.row] * 256 + suffixes.offset, suffixes)
        edges = np.concatenate([[0], np.cumsum(suffixes.many)])
        some = np.flatnonzero(np.add.reduceat(flags, edges[:-1]) > 0) if len(flags) else np.zeros(0, np.int64)
        yield table({
            "seed": (seed[some], pa.int64()), "seg": (rows.column("seg").to_numpy()[some], pa.int64()),
            "runs": ([runs_of(flags[edges[x]: edges[x + 1]]) for x in some.tolist()], pa.list_(pa.int32())),
        })


def _dealt(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A row with digests for each suffix."""
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            suffixes = Suffixes(rows, length)
            pick = pa.array(suffixes.row)
            yield table({
                "seed": (batch.column("seed").take(pick), None), "seg": (batch.column("seg").take(pick), None), "nth": (suffixes.nth, pa.int32()),
                "offset": (suffixes.offset, pa.int32()), "one": (suffixes.token(1).view(np.int64), pa.int64()), "two": (suffixes.token(2).view(np.int64), pa.int64()),
            })


def _removed(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, sizes, gone, runs, digests = [], [], [], [], []
        for text, some in zip(batch.column("text").to_pylist(), batch.column("spans")):
            data = text.encode()
            n = edges = 0
            size = len(data)
            if some.is_valid:
                flags = covered_units(size, some.values, length)
                n = int(flags.sum())
                edges = int(flags[:1].sum() + (flags[1:] & ~flags[:-1]).sum())
                data = np.frombuffer(data, np.uint8)[~flags].tobytes()
            kept.append(data)
            sizes.append(size)
            gone.append(n)
            runs.append(edges)
            digests.append(hashlib.sha256(data).hexdigest())
        yield table({
            "key": (batch.column("key"), None), "mark": (batch.column("mark"), None), "kept": (kept, pa.binary()), "n_bytes": (sizes, pa.int64()),
            "n_removed": (gone, pa.int64()), "n_spans": (runs, pa.int64()), "kept_sha256": (digests, pa.string()),
        })


def without_repeated_bytes(docs: DataFrame, length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """Per document: key, mark, the bytes kept, n_bytes, n_removed, n_spans (removed runs), kept_sha256.

    A byte goes when a string of ``length`` bytes of its document over it also starts anywhere else, in any row
    or at another place of the same one. Null texts are empty. Rows that repeat an id are separate texts, and rows
    that repeat a text repeat all its strings. ``hot`` bounds the different surroundings of one anchor that are
    sorted in one bucket; beyond it the same suffixes are counted across buckets. Other columns are not read.
    """
    keyed = row_keys(docs)
    found = hits(keyed, length, seed, False, F.col("n") > 1)
    segments = landed(found.groupBy("seed", "seg").agg(F.sum("copies").alias("n"), F.min(F.struct("key", "mark", "at")).alias("one")), "segments")
    open_ = segments.join(several(segments), "seed").select("one.key", "one.mark", "one.at", "seed", "seg", "segs")
    stretches = landed(looked_up(keyed, open_.select("key", "mark", "at", "seed", "seg")).mapInArrow(partial(_stretches, length=length, seed=seed), STRETCH), "stretches")
    crowded = open_.filter(F.col("segs") > hot).select("seed").distinct()
    cold = stretches.join(crowded, "seed", "left_anti").repartitionByRange("lead", "seed").sortWithinPartitions("lead", "seed")
    runs = cold.mapInArrow(partial(_sorted, length=length), "seed bigint, seg bigint, runs array<int>")
    dealt = stretches.join(crowded, "seed", "left_semi").mapInArrow(partial(_dealt, length=length), "seed bigint, seg bigint, nth int, offset int, one bigint, two bigint")
    same = ["seed", "offset", "one", "two"]
    twice = landed(dealt.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*same), "crowded-suffixes")
    across = dealt.join(twice, same).groupBy("seed", "seg").agg(F.collect_set("nth").alias("nths")).select("seed", "seg", F.flatten(F.transform("nths", lambda x: F.array(x, x))).alias("runs"))
    runs = landed(runs.unionByName(across), "runs")
    discarded(stretches)

    verdicts = landed(segments.select("seed", "seg", "n").join(runs, ["seed", "seg"], "left").filter("n > 1 or runs is not null"), "verdicts")
    covers = found.join(verdicts, ["seed", "seg"]).select("key", "mark", "at", F.when(F.col("n") == 1, F.col("runs")).alias("runs"))
    return keyed.join(spans(covers), ["key", "mark"], "left").select("key", "mark", "text", "spans").mapInArrow(partial(_removed, length=length), OUT)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_bytes(read(spark, sf_dir, "documents")).select(doc_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256")
