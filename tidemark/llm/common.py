"""What the operators of this subpackage share: reading, row keys, words and tables between steps."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The six bytes that part words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
# Stands for a null doc_id, which counts as later than any other.
NO_ID = (1 << 63) - 1
# Bytes handled by one round of array operations; a worker needs about a hundred times as much for its arrays.
CHUNK_BYTES = 3 << 18


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, UPPER, LOWER)


def parted(text: Column) -> Column:
    """The words of a text, unchanged: runs of anything but the six blanks. None for null."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def n_words(text: Column) -> Column:
    return F.size(parted(text)).cast("bigint")


def row_keys(docs: DataFrame) -> DataFrame:
    """(key, mark, text): the document's id, a hash that tells rows with one id apart, the text (null: empty).

    Rows that agree in both columns have the same id and text, and so the same results. The mark has 64 bits among the rows of one id, and
    128 among those without an id, of which there may be any number.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    short = F.unhex(F.lpad(F.hex(F.xxhash64(text)), 16, "0"))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("key"), F.when(F.col("doc_id").isNull(), F.unhex(F.md5(text))).otherwise(short).alias("mark"), text.alias("text"))


def text_keys(docs: DataFrame) -> DataFrame:
    """As ``row_keys``, but with 128 bits of ``mark``: they also tell any number of texts without an id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("key"), F.unhex(F.md5(text)).alias("mark"), text.alias("text"))


def doc_id(key: str = "key") -> Column:
    return F.nullif(F.col(key), F.lit(NO_ID)).alias("doc_id")


# Bits of a filter, and of one row of it: a table of 1,024 rows of 4 KB at most, whatever the data.
FILTER_BITS, ROW_BITS = 1 << 25, 1 << 15


def likely(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` without most of those whose keys are not ``wanted``: a join that follows shuffles that much less.

    The filter is a bitmap of key hashes of a fixed size (4 MB), so it may be broadcast. It lets through a share of the others that grows
    with the number of wanted keys; from some ten million on it lets through most of them, and only costs its own small pass.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    place = (bit % ROW_BITS).cast("int")
    bits = wanted.select(F.floor(bit / ROW_BITS).cast("int").alias("_slot"), place.cast("bigint").alias("_bit")).groupBy("_slot").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("_slot", F.floor(bit / ROW_BITS).cast("int")).join(F.broadcast(bits), "_slot")
    return met.filter(F.call_function("shiftright", byte, place % 8).bitwiseAND(1) == 1).select(*rows.columns)


def unshared(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps now rather than at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def landed(df: DataFrame, name: str) -> DataFrame:
    """The rows as a compressed table in the shared folder: cuts the lineage, survives lost executors, has a known size."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    unshared(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._landed_at = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Delete landed tables that no later step reads."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._landed_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, ends) with about CHUNK_BYTES of text at a time; one long text stays whole."""
    for batch in batches:
        texts = batch.column(column)
        if batch.num_rows == 0:
            continue
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
            last = min(last, len(texts))
            yield batch.slice(first, last - first), data[offsets[first]: offsets[last]], offsets[first + 1: last + 1] - offsets[first]
            first = last
        # A worker outlives its task; what a batch of long texts took goes back before the next one.
        del batch, texts, data
        pa.default_memory_pool().release_unused()


_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths) in bytes of every word, and where each document's words end in that list."""
    inside = ~_BLANK[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    firsts = ends[:-1][ends[:-1] < len(data)]
    opens[firsts] = inside[firsts]
    starts = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    lasts = ends[(ends > 0)] - 1
    closes[lasts] = inside[lasts]
    return starts, np.flatnonzero(closes) + 1 - starts, np.searchsorted(starts, ends, "left")


def table(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    arrays = [values if isinstance(values, pa.Array) else pa.array(values, type=kind) for values, kind in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))
