"""Helpers the operators share: texts as bytes, vectorised words and hashes, tables, folds, staging."""

from __future__ import annotations

import atexit
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from tidelake.session import delete_folder, scratch_dir

#: Bytes of text that are worked on at once inside a task; one longer text is worked on alone.
SLICE_BYTES = 1 << 18

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWERED_VALUES = _BYTE_VALUES.copy()
_LOWERED_VALUES[65:91] = _BYTE_VALUES[97:123]

#: Bytes of a word, by the pattern [^\x20\x09-\x0D]+ .
SPACED_WORD = np.ones(256, bool)
SPACED_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a word, by the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ over text with A-Z lower-cased.
PLAIN_WORD = np.ones(256, bool)
PLAIN_WORD[:128] = [chr(i).isdigit() or chr(i).isalpha() for i in range(128)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The frame, written once to the shared folder and read again: what follows does not depend on its lineage.

    The folder goes with `unstaged`, or when the program ends: frames that are returned may still read it.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    frame = df.sparkSession.read.schema(df.schema).parquet(path)
    frame.staged_at = path
    if not _staged:
        atexit.register(_unstage_all)
    _staged[path] = df.sparkSession
    return frame


_staged: dict[str, SparkSession] = {}


def unstaged(*frames: DataFrame) -> None:
    """Remove the folders of staged frames that nothing reads any more."""
    for frame in frames:
        delete_folder(_staged.pop(frame.staged_at), frame.staged_at)


def _unstage_all() -> None:
    for path, spark in _staged.items():
        if spark.sparkContext._jsc is not None:  # stopped: its folders are left to whoever owns the shared folder
            delete_folder(spark, path)


def widened(df: DataFrame, **columns: DataType) -> StructType:
    """The frame's schema with more columns at its end."""
    return StructType([*df.schema.fields, *(StructField(name, kind) for name, kind in columns.items())])


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's labels are kept from learning: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, max_rows: int, *metadata: str) -> DataFrame:
    """(doc_id, text, metadata, label) of at most `max_rows` labelled rows that are not held out, chosen by a hash of the id.

    The bound makes the chosen labels safe to broadcast. Null labels and ids take no part; of an id with several
    labels the largest counts. Of an id that several documents share either all rows or none are taken, those with the
    fewest rows first; the documents are counted by their ids alone.
    """
    chosen = (
        labels.select("doc_id", F.col(label).alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    counted = documents.select("doc_id").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    along = Window.orderBy("n", F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # max_rows rows at most
    bounded = counted.withColumn("so_far", F.sum("n").over(along)).where(F.col("so_far") <= max_rows).select("doc_id", "label")
    return documents.select("doc_id", "text", *metadata).join(F.broadcast(bounded), "doc_id")


# ---------------------------------------------------------------- texts as bytes


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of strings and the offsets of its rows; a null counts as an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `size` bytes each."""
    data, offsets = text_bytes(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1
        high = min(n, max(low + 1, high))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, for steps that hold several copies of their texts."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and for each text the number of its first word (one more at the end)."""
    inside = is_word[data]
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        tables = []
        for base in (_MULTIPLIER, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers = (tables[0], tables[1])
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the value."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray, lowered: bool = False) -> np.ndarray:
    """What `hashes_between` needs of the bytes; with `lowered`, A-Z count as a-z."""
    power, _ = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWERED_VALUES if lowered else _BYTE_VALUES)[data] * power[: len(data)], out=sums[1:])
    return sums


def hashes_between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes, wherever they stand."""
    _, inverse = _power_tables(len(sums))
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lowered: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; with `lowered`, A-Z count as a-z."""
    return hashes_between(prefix_sums(data, lowered), starts, ends)


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `k` words that lie in one text, and the number of each run's first word.

    `first`: for each text the number of its first word, and one more at the end.
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = hashes[:n].copy()
    for i in range(1, k):
        h = mixed(h * _MULTIPLIER + hashes[i : i + n])
    fits = np.ones(n + k, bool)
    for edge in first[1:-1]:
        fits[max(0, edge - k + 1) : edge] = False
    at = np.flatnonzero(fits[:n])
    return h[at], at


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)
