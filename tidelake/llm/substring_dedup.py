"""Removal of repeated passages by content-defined chunking.

A gear rolling hash runs over the bytes of a text. A word's end is a chunk's end if the hash there is the smallest among the
words around it, so that where a chunk ends depends on the bytes nearby alone: after an insertion the cuts soon fall in
the same places again. Chunks that follow each other and have just enough words are a window, known by a digest; of windows
that are alike the first by document and place stays, and what lies in the others is cut out. So all that is cut stands
together in an earlier place; fewer words say little and stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidelake.llm._common import SPACED_WORD, in_parts, mixed, slices, widened, words

#: Words on each side among which a chunk's end has the smallest hash.
REACH = 2
#: A longer chunk is cut into pieces of so many words; only text that repeats itself makes such chunks.
LONGEST = 64
#: Bytes that the rolling hash looks back on: 8, by doubling.
DOUBLINGS = 3
#: Words of the shortest passage that is cut out.
LEAST_WORDS = 20

#: Chunks that a task gives out at once, about.
ROWS_AT_ONCE = 100_000

#: The gear: a fixed random number for each byte.
_GEAR = np.random.default_rng(8).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Base of the windows' digests, and its inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of it and the bytes before it: the hash so far, doubled, plus the byte's number."""
    h = _GEAR[data]
    for i in range(DOUBLINGS):
        back = 1 << i
        h[back:] += h[:-back] << np.uint32(back)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def chunk_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of the words that begin a chunk, and the number of words at the end; `ends`: of the text's words."""
    n = len(ends)
    if not n:
        return np.zeros(1, np.int64)
    h = np.concatenate([np.full(REACH, 1 << 32), gear_hash(data)[ends - 1].astype(np.int64), np.full(REACH, 1 << 32)])
    own = h[REACH : REACH + n]
    cut = np.ones(n, bool)
    for i in range(1, REACH + 1):
        cut &= (own < h[REACH - i : REACH - i + n]) & (own <= h[REACH + i : REACH + i + n])
    cut[-1] = True
    starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
    if (long := np.diff(starts) > LONGEST).any():
        more = [np.arange(a, b, LONGEST) for a, b in zip(starts[:-1][long], starts[1:][long], strict=True)]
        starts = np.unique(np.concatenate([starts, *more]))
    return starts


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its row, its words' starts and ends, the words that begin chunks (and the end), and the digests."""
    for low, _, data, offsets in slices(column):
        starts, ends, first = words(data, offsets, SPACED_WORD)
        raw = memoryview(data)
        for i in range(len(offsets) - 1):
            a, b = offsets[i], offsets[i + 1]
            s, e = starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]]
            at = chunk_starts(data[a:b], e - a)
            digests = [xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(s[at[:-1]].tolist(), e[at[1:] - 1].tolist(), strict=True)]
            yield low + i, s - a, e - a, at, np.array(digests, np.uint64).view(np.int64)


def windows(at: np.ndarray, digests: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end chunk, and digest, of the shortest windows from each chunk on, and up to each, with at least so many words."""
    n = len(at)
    ends = np.searchsorted(at, at[:-1] + least)
    starts = np.searchsorted(at, at[1:] - least, "right") - 1
    pairs = np.concatenate([(np.arange(n - 1) * n + ends)[ends < n], (starts * n + np.arange(1, n))[starts >= 0]])
    a, b = np.divmod(np.unique(pairs), n)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE)]))
    back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _UNBASE)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(digests.view(np.uint64)) * powers[:-1], dtype=np.uint64)])
    return a, b, mixed((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64)).view(np.int64)


# A window's place in one number: its first word, its words, and whether the text has had it before, and not in the same words.


def _places(at: np.ndarray, a: np.ndarray, b: np.ndarray, digests: np.ndarray) -> np.ndarray:
    _, first, of = np.unique(digests, return_index=True, return_inverse=True)
    return at[a] << 32 | (at[b] - at[a]) << 1 | (b[first[of]] <= a)


def _window_rows(least: int):
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            rows, places, digests, held = [], [], [], 0
            for row, _, _, at, own in chunks(batch.column("text")):
                a, b, found = windows(at, own, least)
                rows.append(np.full(len(found), row))
                places.append(_places(at, a, b, found))
                digests.append(found)
                held += len(found)
                if held >= ROWS_AT_ONCE or row == len(ids) - 1:
                    whole = [np.concatenate(part) for part in (rows, places, digests)]
                    columns = [ids.take(pa.array(whole[0])), pa.array(whole[1]), pa.array(whole[2])]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "place", "digest"])
                    rows, places, digests, held = [], [], [], 0

    return rows_of


def repeated_windows(documents: DataFrame, least: int) -> DataFrame:
    """(doc_id, place, digest) of every window that is not the first of its digest. Rows without an id take no part.

    The first document of a digest is found by a fold before the shuffle, so a window that a third of all documents have
    comes down to a row for each task; the join that follows can be split at such a window.
    """
    rows = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInArrow(_window_rows(least), "doc_id long, place long, digest long")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where(F.col("n") > 1)
    repeated = (F.col("doc_id") > F.col("first_id")) | (F.col("place") % 2 == 1)
    return rows.join(firsts.select("digest", "first_id"), "digest").where(repeated).select("doc_id", "place", "digest")


def cut_spans(places: np.ndarray, digests: np.ndarray, at: np.ndarray, own: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs [first word, end word) that repeated windows cover, of a text's chunks `at` with digests `own`."""
    a, b, found = windows(at, own, least)
    here = at[a] << 32 | (at[b] - at[a]) << 1
    order = np.argsort(here)
    index = np.minimum(np.searchsorted(here[order], places & ~1), max(0, len(here) - 1))
    if not len(here):
        return []
    index = order[index]
    index = index[(here[index] == places & ~1) & (found[index] == digests)]
    depth = np.zeros(len(own) + 1, np.int64)
    np.add.at(depth, a[index], 1)
    np.add.at(depth, b[index], -1)
    is_cut = np.cumsum(depth[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], is_cut.view(np.int8), [0]])))
    return [(int(at[x]), int(at[y])) for x, y in zip(edges[::2], edges[1::2], strict=True)]


def _cut_rows(least: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            index = batch.schema.get_field_index
            texts, lists = batch.column(index("text")), batch.column(index("_repeated"))
            touched = np.flatnonzero(np.asarray(lists.is_valid()) & np.asarray(texts.is_valid()))
            out, removed = texts.to_pylist(), np.zeros(len(texts), np.int64)
            some = texts.take(pa.array(touched))
            for row, starts, _, at, own in chunks(some):
                i = int(touched[row])
                found = np.array([(x["place"], x["digest"]) for x in lists[i].as_py()], np.int64).reshape(-1, 2)
                spans = cut_spans(found[:, 0], found[:, 1], at, own, least)
                if spans:
                    data, parts, last = out[i].encode(), [], 0
                    for a, b in spans:
                        parts.append(data[last : starts[a]])
                        last = int(starts[b]) if b < len(starts) else len(data)
                    out[i] = b"".join([*parts, data[last:]]).decode()
                    removed[i] = sum(b - a for a, b in spans)
            columns = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "_repeated"]
            names = [name for name in batch.schema.names if name != "_repeated"]
            columns[names.index("text")] = pa.array(out, pa.string())
            if "n_chars" in names:
                n_chars = batch.column(index("n_chars")).to_pylist()
                columns[names.index("n_chars")] = pa.array([len(t) if r else n for t, n, r in zip(out, n_chars, removed, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed)], names=[*names, "n_removed"])

    return cut


def remove_repeats(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents without repeated passages, with the number of words that were cut out as `n_removed`.

    All rows stay, with all their columns; `n_chars`, where there is one, is the new length of a text that was cut. A passage
    stays in the document with the smallest id that has it, at its first place there. A passage is found by the windows
    that lie in it whole: a dozen words at its edges may stay. Rows that repeat an id are one document and are cut alike;
    a row whose text has no window of a digest at a place is not cut there. Null texts and rows without an id stay as
    they are. Columns called `n_removed` or `_repeated` are replaced.
    """
    documents = documents.drop("n_removed", "_repeated")
    if "n_chars" in documents.columns:
        documents = documents.withColumn("n_chars", F.col("n_chars").cast("long"))
    found = repeated_windows(documents, least_words).groupBy("doc_id").agg(F.collect_list(F.struct("place", "digest")).alias("_repeated"))
    joined = documents.join(found.withColumnRenamed("doc_id", "_of"), F.col("doc_id") == F.col("_of"), "left").drop("_of")
    return joined.mapInArrow(_cut_rows(least_words), widened(documents, n_removed=LongType()))
