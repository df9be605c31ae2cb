"""Documents packed into token sequences by hierarchical best fit.

Documents become token ids with an end mark; only longer ones than a sequence are cut. Pieces are dealt to blocks of
bounded size. A block fits its pieces, longest first, each into the fullest sequence that has room. Sequences that are
nearly full are done; the others go up a tree as items of their own, ``FAN_IN`` blocks into one, and are fitted
again, so what one block lacks another fills. A sequence's number is that of its first piece.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_id, landed, read, row_keys, table

LIMIT = 4096
END = 1
# Pieces fitted in one block.
BLOCK = 16_384
FAN_IN = 8
# Tokens a sequence may lack and still count as nearly full.
NEARLY = 8
# Distinct words whose ids a worker keeps at hand.
KNOWN = 800_000
CHUNK = 1 << 21

_tokenizers: dict = {}
# Characters at which str.split parts words though the tokenizers' white space does not include them.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# How a tokenizer of lower-cased words works; only such a one is taken apart.
STEPS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in seen]
    return {byte: chr(byte) for byte in seen} | {byte: chr(256 + at) for at, byte in enumerate(hidden)}


class _Pieces(dict):
    """Ids of the parts that a word is split into, as little-endian bytes; unknown ones are merged by the model."""

    def __init__(self, tokenizer) -> None:
        self._merge, self._letters = tokenizer.model.tokenize, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        letters = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self._letters)
        found = self[piece] = np.array([token.id for token in self._merge(letters)], "<u4").tobytes()
        return found


class _Words(dict):
    """Ids of words (no white space). Latin-1 needs no composing, and its lower case is the same everywhere; the rest goes whole."""

    def __init__(self, tokenizer) -> None:
        import regex

        self._tokenizer, self._split, self.pieces = tokenizer, regex.compile(SPLIT).findall, _Pieces(tokenizer)

    def __missing__(self, word: str) -> bytes:
        if word.isascii() or max(word) < "\u0100":
            found = b"".join(map(self.pieces.__getitem__, self._split(word.lower()))) if "<|" not in word else None
        else:
            found = None
        if found is None:
            found = np.array(self._tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = found
        return found


class WordEncoder:
    """Ids of texts as little-endian bytes.

    Tokens of a tokenizer of lower-cased words never span white space, so each distinct word is encoded once and
    remembered, up to a bound. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self._tokenizer.to_str())
        normal, split = steps.get("normalizer") or {}, (steps.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        by_words = [step.get("type") for step in normal.get("normalizers", [])] == STEPS and split[0].get("pattern") == {"Regex": SPLIT} and split[-1].get("type") == "ByteLevel"
        self._words = _Words(self._tokenizer) if by_words else None

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self._words is None:
            return [self._whole(text) for text in texts]
        for known in (self._words, self._words.pieces):
            if len(known) > KNOWN:
                known.clear()
        ids = self._words.__getitem__
        return [self._whole(text) if any(mark in text for mark in _SEPARATORS) else b"".join(map(ids, text.split())) for text in texts]


def _encoder(path: str) -> WordEncoder:
    if path not in _tokenizers:
        _tokenizers[path] = WordEncoder(path)
    return _tokenizers[path]


def _pieces(batches: Iterable[pa.RecordBatch], path: str, limit: int, ids: bool) -> Iterator[pa.RecordBatch]:
    encode = _encoder(path)
    mark = np.array([END], "<u4").tobytes()
    for batch in batches:
        texts, keys = batch.column("text").to_pylist(), batch.column("key").to_pylist()
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and size < CHUNK:
                size += len(texts[last])
                last += 1
            rows = []
            for key, coded in zip(keys[first:last], encode(texts[first:last])):
                coded += mark
                for start in range(0, len(coded), 4 * limit):
                    part = coded[start: start + 4 * limit]
                    rows.append((key, start // (4 * limit), start // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4") if ids else None))
            columns = list(zip(*rows))
            yield table({
                "key": (columns[0], pa.int64()), "piece": (columns[1], pa.int32()), "start": (columns[2], pa.int64()), "length": (columns[3], pa.int64()),
                "ids_crc32": (columns[4], pa.int64()), **({"ids": (list(columns[5]), pa.list_(pa.int32()))} if ids else {}),
            })
            first = last


def pieces(docs: DataFrame, path: str | None = None, limit: int = LIMIT, ids: bool = True) -> DataFrame:
    """(serial, key, piece, start, length, ids_crc32 and, if asked for, ids) of every document, as a landed table.

    A null text is empty and gives one piece, the end mark. Rows that repeat an id give pieces of their own; serial tells them apart.
    """
    schema = "key bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if ids else "")
    cut = row_keys(docs).select("key", "text").mapInArrow(partial(_pieces, path=path or tokenizer_path(), limit=limit, ids=ids), schema)
    return landed(cut.withColumn("serial", F.monotonically_increasing_id()), "pieces")


def best_fit(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, in the order given; bins are numbered by their first item."""
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms = 0  # bit r is set while a bin with room r is open
    home, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for at, size in enumerate(sizes.tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            here = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, here = limit, at
        home[at], offset[at] = here, limit - room
        room -= size
        if room:
            by_room[room].append(here)
            rooms |= 1 << room
    return home, offset


def _fit(rows: pd.DataFrame, limit: int, nearly: int, carry: int) -> pd.DataFrame:
    """Items of a block with their bins; ``goes`` marks the first item of a bin that goes up, ``fill`` is its size."""
    rows = rows.sort_values(["size", "item"], ascending=[False, True], kind="stable")
    item, size = rows["item"].to_numpy(), rows["size"].to_numpy()
    home, offset = best_fit(size, limit)
    fill = np.bincount(home, size, len(size)).astype(np.int64)
    heads = np.flatnonzero(fill)
    under = heads[fill[heads] < limit - nearly]
    under = under[np.argsort(fill[under], kind="stable")][:carry]
    goes = np.zeros(len(size), bool)
    goes[under] = True
    return pd.DataFrame({"block": rows["block"].to_numpy(), "item": item, "bin": item[home], "offset": offset, "fill": fill, "goes": goes})


def packed(items: DataFrame, limit: int = LIMIT, block: int = BLOCK, fan_in: int = FAN_IN, nearly: int = NEARLY) -> DataFrame:
    """(item, sequence_id, offset) for ``items`` (item: distinct numbers, size: 1 to ``limit``).

    Of a block's underfull sequences the ``block`` / ``fan_in`` emptiest go up, so no block gets more than ``block``
    of them; the fuller rest stays as it is, which costs room but loses nothing.
    """
    blocks = max(1, -(-items.count() // block))
    # A block takes a hash range of its own, so its size varies by a few per cent only.
    rows = items.select(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), "item", "size")
    rounds = []
    while True:
        fit = partial(_fit, limit=limit, nearly=nearly, carry=max(1, block // fan_in))
        done = landed(rows.groupBy("block").applyInPandas(fit, "block bigint, item bigint, bin bigint, offset bigint, fill bigint, goes boolean"), "bins")
        rounds.append(done)
        if blocks == 1:
            break
        blocks = -(-blocks // fan_in)
        rows = done.filter("goes").select(F.floor(F.col("block") / F.lit(fan_in)).cast("bigint").alias("block"), "item", F.col("fill").alias("size"))
    placed = rounds[0].select("item", F.col("bin").alias("sequence_id"), "offset")
    for done in rounds[1:]:
        moved = done.select(F.col("item").alias("sequence_id"), F.col("bin").alias("into"), F.col("offset").alias("by"))
        placed = placed.join(moved, "sequence_id", "left").select(
            "item", F.coalesce("into", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
    return placed


def packed_documents(docs: DataFrame, path: str | None = None, limit: int = LIMIT, ids: bool = True) -> DataFrame:
    """The pieces of all documents with their places: sequence_id and offset. Other columns of ``docs`` are not read."""
    cut = pieces(docs, path, limit, ids)
    placed = packed(cut.select(F.col("serial").alias("item"), F.col("length").alias("size")), limit)
    return cut.join(placed.withColumnRenamed("item", "serial"), "serial").drop("serial")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): whole sequences, from the result of ``packed_documents`` with ids."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def digests(docs: DataFrame) -> DataFrame:
    return packed_documents(docs, ids=False).select(doc_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
