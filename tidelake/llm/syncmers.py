"""Document fingerprints of closed syncmers.

A k-mer of bytes is a closed syncmer if the smallest hash of its inner s-mers is at its first or last place. Whether a k-mer
is chosen depends on the k-mer alone, so an edit changes only the anchors that it touches. A fingerprint holds the anchors
with the smallest hashes, each with its first place. Two fingerprints are alike by the anchors, among the smallest of both,
that they have in common at one offset.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm._common import mixed

#: Bytes of a k-mer and of an inner s-mer.
K, S = 12, 4
#: Anchors of a fingerprint, at most.
ANCHORS = 48
#: Common anchors count if their offsets lie within so many bytes of the usual one.
BAND = 64


def closed_syncmers(data: np.ndarray) -> np.ndarray:
    """The places of the bytes' closed syncmers, ascending."""
    n = len(data) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    pairs = data[:-1].astype(np.uint32) | (data[1:].astype(np.uint32) << np.uint32(8))
    h = (pairs[:-2] | (pairs[2:] << np.uint32(16))) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(13)
    inner = K - S + 1  # s-mers of a k-mer; 9: the smallest of 8 by doubling, and one more
    least = h
    for step in (1, 2, 4):
        least = np.minimum(least[:-step], least[step:])
    least = np.minimum(least[:n], h[inner - 1 : inner - 1 + n])
    return np.flatnonzero((h[:n] == least) | (h[inner - 1 : inner - 1 + n] == least))


def anchors(data: np.ndarray) -> np.ndarray:
    """Up to ANCHORS rows of (hash, first place), by ascending hash; of a text without syncmers, one of the whole text."""
    at = closed_syncmers(data)
    if not len(at):
        if not len(data):
            return np.zeros((0, 2), np.uint32)
        whole = hashlib.blake2b(data.tobytes(), digest_size=4).digest()
        return np.array([[int.from_bytes(whole), 0]], np.uint32)
    words = np.zeros(len(at), np.uint64)
    for i in range(K):
        words = words * np.uint64(0x9E3779B97F4A7C15) + data[at + i]
    h = (mixed(words) >> np.uint64(32)).astype(np.uint32)
    if len(h) > 4 * ANCHORS:
        # Repeats make ties: all that are not above the smallest bound with enough distinct values stay.
        few = 4 * ANCHORS
        while few < len(h):
            low = h <= np.partition(h, few)[few]
            if len(np.unique(h[low])) >= ANCHORS:
                h, at = h[low], at[low]
                break
            few *= 4
    values, first = np.unique(h, return_index=True)
    return np.column_stack([values, at[first]])[:ANCHORS].astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: of the union's smallest anchors, twice those that both have at the usual offset by those of each; 1 for two empty texts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a[:, 0], b[:, 0])[:ANCHORS]
    common, in_a, in_b = np.intersect1d(a[:, 0], b[:, 0], assume_unique=True, return_indices=True)
    kept = common <= union[-1]
    if not kept.any():
        return 0.0
    offsets = (b[in_b, 1].astype(np.int64) - a[in_a, 1].astype(np.int64))[kept]
    usual = np.sort(offsets)[len(offsets) // 2]
    same = int((np.abs(offsets - usual) <= BAND).sum())
    return 2 * same / (len(union) + same)


def to_text(found: np.ndarray) -> str:
    """Sixteen hexadecimal digits an anchor: hash and place."""
    return found.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").reshape(-1, 2).astype(np.uint32)


def fingerprint(text: str | None) -> str:
    """Fingerprint of a whole text; null and empty texts have an empty one, equal texts equal ones."""
    return to_text(anchors(np.frombuffer((text or "").encode(), np.uint8)))


# ---------------------------------------------------------------- each document and the next


def in_ranges(documents: DataFrame) -> DataFrame:
    """(range, tail, doc_id, text) sorted by range: a range's documents by id, then with `tail` those that follow it.

    Ranges are bounded by quantiles of the ids, one for each shuffle partition. The documents with the first id of a range are sent to the range before as
    well; those of the first range, to the last. Null ids come first. What reaches the driver are ids, a few for each
    partition.
    """
    spark = documents.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = partitions
    documents = documents.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    as_double = F.col("doc_id").cast("double")
    ids = documents.select("doc_id", as_double.alias("_id"))
    bounds = sorted(set(ids.approxQuantile("_id", [i / n for i in range(1, n)], 1 / (4 * n))))
    splits = [-float("inf"), *bounds, float("inf")]

    def ranged(frame: DataFrame) -> DataFrame:
        if len(splits) < 3:
            return frame.withColumn("range", F.lit(0))
        cut = Bucketizer(splits=splits, inputCol="_id", outputCol="_range", handleInvalid="keep")
        found = F.when(F.col("_id").isNull(), F.lit(0)).otherwise(F.col("_range").cast("int"))
        return cut.transform(frame).withColumn("range", found).drop("_range")

    firsts = ranged(ids).groupBy("range").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("has_null")).collect()
    first: list[int | None] = [None] * len(splits)
    before: list[int | None] = [None] * len(splits)
    filled = sorted(row.range for row in firsts)
    for row in firsts:
        first[row.range] = None if row.has_null else row.first
        before[row.range] = filled[filled.index(row.range) - 1]
    of_range = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("range") + 1)
    own = F.struct(F.col("range"), F.lit(False).alias("tail"))
    ahead = F.struct(of_range(before, "int").alias("range"), F.lit(True).alias("tail"))
    is_first = F.col("doc_id").eqNullSafe(of_range(first, "long"))
    placed = ranged(documents.withColumn("_id", as_double)).withColumn("place", F.explode(F.when(is_first, F.array(own, ahead)).otherwise(F.array(own))))
    rows = placed.select("place.range", "place.tail", "doc_id", "text")
    return rows.repartitionById(partitions, "range").sortWithinPartitions("range", "tail", F.col("doc_id").asc_nulls_first(), "text")


def edited(text: str, following: str) -> str:
    """The text with the last half of its code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # the last document, its range and anchors; it waits for the next
    for batch in batches:
        out = []
        for place, tail, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if held is None or held[0] != place:
                if not tail:
                    held = (place, doc_id, text, anchors(np.frombuffer(text.encode(), np.uint8)))
                continue
            own = anchors(np.frombuffer(text.encode(), np.uint8))
            before, before_anchors = held[2], held[3]
            changed = edited(before, text).encode()
            changed_anchors = anchors(np.frombuffer(changed, np.uint8))
            out.append(
                (
                    held[1],
                    len(before),
                    hashlib.sha256(changed).hexdigest(),
                    to_text(before_anchors),
                    to_text(changed_anchors),
                    likeness(before_anchors, changed_anchors),
                    likeness(before_anchors, own),
                )
            )
            held = None if tail else (place, doc_id, text, own)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [part.split()[0] for part in _FINGERPRINTS.split(", ")]
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The next document is the one that follows by id, after the last the first; rows that repeat an id follow each other by
    text, null ids come first, and a document alone is its own next. Null texts are empty. Other columns are ignored; an
    empty table gives no rows.
    """
    return in_ranges(documents).mapInArrow(_compare, _FINGERPRINTS)
