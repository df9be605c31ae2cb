"""Near duplicates by SetSketch registers.

A document's set of word shingles becomes ``REGISTERS`` registers. Each is a minimum over the set of
exponentially distributed hash values, kept only to its place on an exponentially spaced scale and truncated at
both ends: K = floor(1 - log_BASE(minimum)) between 0 and 255. The register of a union is the larger one, and
two registers are equal about as often as an element of the union is common, so bands of registers are keys
of a locality-sensitive join. Which of two registers is larger also says something: with the known set
sizes, the counts of larger, smaller and equal registers give the similarity by maximum likelihood. Pairs
whose estimate may reach the threshold are then verified on their full sets.

No step forms all pairs of a bucket:

* documents with the same set are one class from the start;
* every member of a bucket is first held against one pivot of it, and the best of these pairs are verified;
* documents connected by pairs that may be similar enough, verified or not, form a family. In buckets that hold several
  families, members outside the largest one are held against the others, in blocks of bounded size, and a block returns
  a forest: fewer pairs than it has families. A few bands come first, so that the others find few buckets open;
* in families that still have several components, members outside the largest one are held against the others once more,
  in blocks with their full sets, and only links that connect something new leave a block.

Every pair that shares a band, may be similar enough and isn't connected otherwise is verified in the end, so the
components are those of all links that the bands can see. At similarity 0.8 exactly and with equal sizes, a pair has no
common band with a probability of a few 1e-6, and an estimate below the floor with one of about 2e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.prefix import dense_index
from .common import NO_ID, chunks, doc_id, landed, likely, read, table, text_keys, words
from .graph import components
from .windows import Rolling, mixed, word_units

REGISTERS = 128
ROWS = 6
BANDS = 48
BASE = 1.2
RATE = 20.0
# Estimates below the threshold by this much are not verified: so few are lost at 0.8 as have no common band.
SLACK = 0.19
# Members of a bucket on either side of one block.
BLOCK = 512
# Pairs compared and pairs estimated by one round of array operations.
PAIRS = 1 << 13
SLICE = 1 << 11
# Of each member, so many pairs with pivots are verified first.
BEST = 2
# Bands whose buckets are opened before those of the others.
FIRST_BANDS = 4

CELL = ["bucket", "row", "column"]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FLIP = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64))
_TIMES = mixed(np.arange(1001, REGISTERS + 1001, dtype=np.uint64)) | np.uint64(1)
_BAND = np.concatenate([np.random.default_rng(at).permutation(REGISTERS)[: REGISTERS // ROWS * ROWS].reshape(-1, ROWS) for at in range(-(-BANDS * ROWS // REGISTERS) + 1)])[:BANDS]
SIGNED = "key bigint, mark binary, n bigint, digest binary, registers binary, bands array<bigint>"


def registers(elements: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for first in range(0, len(elements), 4096):
        part = (elements[first: first + 4096, None] ^ _FLIP) * _TIMES
        np.minimum(least, part.min(0), out=least)
    drawn = -np.log1p(-np.maximum(least.astype(np.float64), 1.0) / 2.0**64 * (1 - 2**-53)) / RATE
    return np.clip(np.floor(1 - np.log(drawn) / np.log(BASE)), 0, 255).astype(np.uint8)


def shingle_sets(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The sorted distinct shingle hashes of every document; A-Z in lower case, words parted by the six blanks.

    A document with fewer words has its whole sequence as its one shingle, and none without words.
    """
    for batch, data, ends in chunks(batches):
        data = _LOWER[data]
        starts, sizes, closes = words(data, ends)
        rolling = Rolling(word_units(data, starts, sizes, 1)[0], 3)
        sets = []
        first = 0
        for last in closes.tolist():
            n = last - first
            if n >= width:
                sets.append(np.unique(rolling.at(np.arange(first, last - width + 1), width)))
            elif n:
                sets.append(rolling.at(np.array([first]), n))
            else:
                sets.append(np.zeros(0, np.uint64))
            first = last
        yield batch, sets


def _sign(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    place = np.arange(ROWS, dtype=np.int64) * 8
    offset = np.arange(BANDS, dtype=np.int64) << 48
    for batch, sets in shingle_sets(batches, width):
        drawn = [registers(one) for one in sets]
        yield table({
            "key": (batch.column("key"), None), "mark": (batch.column("mark"), None), "n": ([len(one) for one in sets], pa.int64()),
            "digest": ([hashlib.blake2b(one.tobytes(), digest_size=16).digest() for one in sets], pa.binary()),
            "registers": ([one.tobytes() for one in drawn], pa.binary()),
            "bands": ([offset + (one[_BAND].astype(np.int64) << place).sum(1) for one in drawn], pa.list_(pa.int64())),
        })


def _sets(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch, sets in shingle_sets(batches, width):
        yield table({"node": (batch.column("node"), None), "elements": ([one.tobytes() for one in sets], pa.binary())})


def estimated(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs from their registers (rows) and set sizes."""
    if len(left) > SLICE:
        return np.concatenate([estimated(*[part[at: at + SLICE] for part in (left, right, n_left, n_right)]) for at in range(0, len(left), SLICE)])
    more = (left > right).sum(1)
    less = (left < right).sum(1)
    same = REGISTERS - more - less
    share = n_left / (n_left + n_right)
    grid = np.linspace(0.0, 1.0, 101)[None, :] * np.minimum(share / (1 - share), (1 - share) / share)[:, None]
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = chance(share[:, None] - (1 - share)[:, None] * grid), chance((1 - share)[:, None] - share[:, None] * grid)
    tiny = 1e-12
    score = more[:, None] * np.log(up + tiny) + less[:, None] * np.log(down + tiny) + same[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return grid[np.arange(len(grid)), score.argmax(1)]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _estimate(batches: Iterable[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        found = estimated(_matrix(batch.column("r_a")), _matrix(batch.column("r_b")), *[batch.column(name).to_numpy().astype(float) for name in ("n_a", "n_b")])
        keep = found >= floor
        yield table({"a": (batch.column("a").filter(pa.array(keep)), None), "b": (batch.column("b").filter(pa.array(keep)), None), "estimate": (found[keep], pa.float64())})


def _linked(left: pa.Scalar, right: pa.Scalar, percent: int) -> bool:
    one, two = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(two) - both)


def _verify(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [_linked(left, right, percent) for left, right in zip(batch.column("e_a"), batch.column("e_b"))]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _whole(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows, sorted by ``keys``, in pieces that hold whole groups, with the number of each row's group."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, *([] if batch is None else [batch])]) if held or batch is not None else None
        if rows is None:
            return
        columns = [rows.column(name).to_numpy() for name in keys]
        new = np.concatenate([[0], np.logical_or.reduce([one[1:] != one[:-1] for one in columns])]).astype(bool)
        last = len(new) if batch is None else int(np.flatnonzero(new)[-1]) if new.any() else 0
        if last:
            yield rows.slice(0, last).combine_chunks(), np.cumsum(new[:last])
        held = rows.slice(last).to_batches()


def _plausible(rows: pa.Table, group: np.ndarray, floor: float, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of side 1, row of side 2, estimate) of pairs of different components of a group that reach ``floor``; all of a row at once."""
    node, comp, n, side = (rows.column(name).to_numpy() for name in ("node", "comp", "n", "side"))
    sketch = _matrix(rows.column("registers"))
    aside, whole = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    many = np.bincount(group[whole], minlength=group[-1] + 1)
    begin = np.cumsum(many) - many
    pairs = many[group[aside]]
    upto = np.cumsum(pairs)
    first = 0
    while first < len(aside):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] - pairs[first] + PAIRS, "right")))
        mine, count = aside[first:last], pairs[first:last]
        one = np.repeat(mine, count)
        two = whole[np.repeat(begin[group[mine]] - (np.cumsum(count) - count), count) + np.arange(len(one))]
        fits = (comp[one] != comp[two]) & (np.minimum(n[one], n[two]) >= threshold * np.maximum(n[one], n[two]) - 1e-9)
        one, two = one[fits], two[fits]
        alike = (sketch[one] == sketch[two]).sum(1) >= (floor - 0.1) * REGISTERS
        one, two = one[alike], two[alike]
        guess = estimated(sketch[one], sketch[two], n[one].astype(float), n[two].astype(float))
        good = guess >= floor
        one, two, guess = one[good], two[good], guess[good]
        yield one, two, guess
        first = last


class Sets:
    """Disjoint sets of a cell's labels; each is known by its smallest one."""

    def __init__(self) -> None:
        self._over: dict[int, int] = {}

    def top(self, x: int) -> int:
        path = []
        while x in self._over:
            path.append(x)
            x = self._over[x]
        for one in path[:-1]:
            self._over[one] = x
        return x

    def joined(self, x: int, y: int) -> bool:
        """Whether the two were apart, and are one now."""
        x, y = self.top(x), self.top(y)
        if x == y:
            return False
        self._over[max(x, y)] = min(x, y)
        return True


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return table({"a": ([min(pair) for pair in found], pa.int64()), "b": ([max(pair) for pair in found], pa.int64())})


def _across(batches: Iterable[pa.RecordBatch], floor: float, threshold: float) -> Iterator[pa.RecordBatch]:
    """A forest of pairs that may be similar enough, between the families of a cell: fewer pairs than it has families."""
    for rows, group in _whole(batches, CELL):
        node, comp = (rows.column(name).to_numpy() for name in ("node", "comp"))
        joined: dict[int, Sets] = {}
        found = []
        for one, two, _ in _plausible(rows, group, floor, threshold):
            # Of many pairs between the same two families one will do.
            x, y = np.minimum(comp[one], comp[two]), np.maximum(comp[one], comp[two])
            order = np.lexsort([y, x, group[one]])
            new = np.ones(len(order), bool)
            new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1]) | (group[one][order][1:] != group[one][order][:-1])
            for at in order[new].tolist():
                if joined.setdefault(int(group[one[at]]), Sets()).joined(int(x[at]), int(y[at])):
                    found.append((int(node[one[at]]), int(node[two[at]])))
        yield _pairs(found)


def _settle(batches: Iterable[pa.RecordBatch], floor: float, threshold: float, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between the components of a family, verified on full sets; those that connect nothing new are left out."""
    for rows, group in _whole(batches, CELL):
        node, comp, sets = rows.column("node").to_numpy(), rows.column("comp").to_numpy(), rows.column("elements").combine_chunks()
        found, joined = [], Sets()
        for one, two, guess in _plausible(rows, group, floor, threshold):
            for at in np.argsort(-guess, kind="stable").tolist():
                left, right = int(one[at]), int(two[at])
                x, y = joined.top(int(comp[left])), joined.top(int(comp[right]))
                if x != y and _linked(sets[left], sets[right], percent):
                    joined.joined(x, y)
                    found.append((int(node[left]), int(node[right])))
        yield _pairs(found)


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80, slack: float = SLACK, block: int = BLOCK) -> DataFrame:
    """One row per document: key, mark, n_shingles, component (the smallest key reachable over links, itself included), kept.

    Documents are linked when 100 * shared shingles >= ``percent`` * shingles of either. Null and empty texts and
    texts of blanks have no shingles and no links. Every different text is a node of its own, also where rows repeat an id or
    have none; such rows share a component only if links connect their texts. A null id counts as the largest. ``kept`` are the
    rows of one text of each component, of its smallest key, and all rows without words. Other columns of ``docs`` are not read.
    """
    threshold, keyed = percent / 100, text_keys(docs)
    floor = threshold - slack
    signed = landed(keyed.mapInArrow(partial(_sign, width=width), SIGNED), "sketches")
    # One node per different set, numbered by the smallest (key, mark) that has it: the smallest node has the smallest key.
    first_of = signed.filter("n > 0").groupBy("digest").agg(F.min(F.struct("key", "mark")).alias("rep")).select("digest", "rep.key", "rep.mark")
    classes = landed(dense_index(first_of, ["key", "mark", "digest"], out="node"), "classes")
    heads = landed(
        signed.join(classes, ["digest", "key", "mark"]).dropDuplicates(["node"]).select("node", "key", "mark", "n", "registers", "bands"), "heads")

    spread = heads.select("node", F.explode("bands").alias("bucket"))
    pivots = landed(spread.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("members")).filter("members > 1"), "pivots")
    held = landed(spread.join(pivots, "bucket").select("bucket", "node", "pivot", "members"), "buckets")
    sizes = heads.select("node", "n", "registers")
    left, right = (sizes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}")) for x in "ab")
    star = held.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    fits = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    guessed = star.join(left.drop("r_a"), "a").join(right.drop("r_b"), "b").filter(fits).join(left.select("a", "r_a"), "a").join(right.select("b", "r_b"), "b").mapInArrow(
        partial(_estimate, floor=floor), "a bigint, b bigint, estimate double")
    first = Window.partitionBy("b").orderBy(F.desc("estimate"), "a")
    pairs = landed(guessed.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= BEST).select("a", "b"), "pairs")

    sets: list[DataFrame] = []

    def built(nodes: DataFrame) -> DataFrame:
        """The sets of ``nodes`` and others; each is built once, when it is first asked for."""
        for known in sets:
            nodes = nodes.join(known.select("node"), "node", "left_anti")
        wanted = landed(heads.join(nodes, "node", "left_semi").select("node", "key", "mark"), "wanted")
        nth = F.row_number().over(Window.partitionBy("key", "mark").orderBy(F.lit(1)))
        texts = likely(keyed, wanted, ["key", "mark"]).join(wanted, ["key", "mark"]).withColumn("nth", nth).filter("nth = 1").select("node", "text")
        sets.append(landed(texts.mapInArrow(partial(_sets, width=width), "node bigint, elements binary"), "sets"))
        return reduce(DataFrame.unionByName, sets)

    def verified(some: DataFrame) -> DataFrame:
        every = built(some.select(F.col("a").alias("node")).union(some.select(F.col("b").alias("node"))).distinct())
        one, two = (every.select(F.col("node").alias(x), F.col("elements").alias(f"e_{x}")) for x in "ab")
        return landed(some.join(two, "b").join(one, "a").mapInArrow(partial(_verify, percent=percent), "a bigint, b bigint"), "links")

    def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
        """Labels after ``links`` between nodes are taken in."""
        if links.isEmpty():
            return labels
        if labels is None:
            return components(links)
        of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l_{x}"))
        moved = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
        over = components(moved)
        every = labels.select("node", "label").union(over.select("node", F.col("node").alias("label"))).dropDuplicates(["node"])
        return landed(every.join(over.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")

    def with_components(members: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return members.withColumn("comp", F.col("node"))
        return members.join(labels, "node", "left").select(*members.columns, F.coalesce("label", "node").alias("comp"))

    def blocks(members: DataFrame) -> DataFrame:
        """Members (bucket, node, comp) of buckets with several components, dealt to the cells of a grid of blocks.

        Side 1, the members outside the largest component, takes a row and all columns; side 2, all members, a column and all rows.
        """
        largest = landed(
            members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("here")).groupBy("bucket")
            .agg(F.max(F.struct("here", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("here").alias("total")).filter("comps > 1")
            .select("bucket", F.col("top.comp").alias("largest"), F.ceil(F.col("total") / block).cast("int").alias("columns"), F.ceil((F.col("total") - F.col("top.here")) / block).cast("int").alias("rows")), "open-buckets")
        dealt = members.join(largest, "bucket")
        chunk = F.xxhash64("node")
        aside = dealt.filter("comp <> largest").select(
            "*", F.pmod(chunk, F.col("rows").cast("bigint")).cast("int").alias("row"), F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"))
        whole = dealt.select(
            "*", F.pmod(chunk, F.col("columns").cast("bigint")).cast("int").alias("column"), F.lit(2).alias("side"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
        return aside.select(*CELL, "side", "node", "comp").unionByName(whole.select(*CELL, "side", "node", "comp")).join(sizes, "node")

    def in_blocks(cells: DataFrame, step) -> DataFrame:
        return cells.repartition(*[F.col(name) for name in CELL]).sortWithinPartitions(*CELL).mapInArrow(step, "a bigint, b bigint").distinct()

    labels = joined(None, verified(pairs))
    # Families are connected by pairs that may be similar enough. The pairs with pivots make most of them; a bucket is only opened where it still holds several.
    families = joined(None, pairs)
    for some in (held.filter(F.col("bucket") < F.lit(FIRST_BANDS << 48)), held.filter(F.col("bucket") >= F.lit(FIRST_BANDS << 48))):
        opened = blocks(landed(with_components(some.select("bucket", "node"), families), "bucket-families"))
        families = joined(families, landed(in_blocks(opened, partial(_across, floor=floor, threshold=threshold)), "pairs"))
    if families is not None:
        apart = with_components(families.select(F.col("label").alias("bucket"), "node"), labels)
        cells = landed(blocks(landed(apart, "families")), "family-blocks")
        every = built(cells.select("node").distinct())
        step = partial(_settle, floor=floor, threshold=threshold, percent=percent)
        labels = joined(labels, landed(in_blocks(cells.join(every, "node"), step), "links"))

    out = classes.select("digest", F.col("key").alias("component"), F.col("mark").alias("head"))
    if labels is not None:
        tops = landed(labels.join(classes.select(F.col("node").alias("label"), F.col("key").alias("component"), F.col("mark").alias("head")), "label").select("node", "component", "head"), "tops")
        out = classes.join(tops, "node", "left").select("digest", F.coalesce("component", "key").alias("component"), F.coalesce("head", "mark").alias("head"))
    stays = (F.col("n") == 0) | ((F.col("key") == F.col("component")) & (F.col("mark") == F.col("head")))
    return signed.select("key", "mark", "n", "digest").join(out, "digest", "left").select(
        "key", "mark", F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component"), stays.alias("kept"))


def without_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Of each component of texts the row with the smallest id, and all without words; columns unchanged.

    Of rows that repeat both id and text one stays.
    """
    kept = landed(near_duplicates(docs, width, percent).filter("kept").select("key", "mark").distinct(), "kept")
    columns = docs.columns
    text = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    marked = docs.select(*[F.col(name).alias(f"c_{at}") for at, name in enumerate(columns)], F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("key"), text.alias("mark"))
    first = Window.partitionBy("key", "mark").orderBy(*[f"c_{at}" for at in range(len(columns))])
    return (
        marked.join(kept, ["key", "mark"], "left_semi").withColumn("_nth", F.row_number().over(first)).filter("_nth = 1")
        .select(*[F.col(f"c_{at}").alias(name) for at, name in enumerate(columns)])
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select(
        doc_id(), "n_shingles", doc_id("component").alias("component_id"), "kept",
    )
