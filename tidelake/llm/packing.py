"""Packing of documents into sequences along a space-filling curve.

Each document's hashed words are projected to a point in a few dimensions, and the point's place on a Hilbert curve is its
key. Documents are sorted by key over ranges, so that neighbours on the curve, which are alike, stand together, and each
range's tokens are cut into sequences one after the other. What is left at a range's end goes into sequences whose lengths
are powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm._common import SPACED_WORD, in_parts, mixed, slices, span_hashes, words

#: Tokens of a sequence.
SEQUENCE = 1024
#: Dimensions of the projection, and bits of each on the curve.
DIMENSIONS, BITS = 3, 10
#: One document in so many is looked at to bound the ranges of the curve.
SAMPLED = 10
#: Bytes of text that a range should have, where that makes more ranges than the session's shuffle partitions, and the
#: finest cut of the sampled keys, which no number of ranges exceeds.
RANGE_BYTES, RANGE_STEPS = 128 << 20, 20_000
#: Pieces of text whose token ids a task keeps since it last put some aside, and as many that are aside.
KEPT_PIECES = 150_000
#: Id at the end of every document.
END = 0


# ---------------------------------------------------------------- place on the curve


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates below 2**bits, [n, dimensions]."""
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    # From coordinates to the transposed index: undo excess work from the highest bit down, then Gray encode.
    bit = np.uint64(1 << (bits - 1))
    while bit > 1:
        low = bit - np.uint64(1)
        for i in range(n):
            set_ = (x[i] & bit) > 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        bit >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = np.uint64(1 << (bits - 1))
    while bit > 1:
        flip ^= np.where((x[n - 1] & bit) > 0, bit - np.uint64(1), np.uint64(0))
        bit >>= np.uint64(1)
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return index.astype(np.int64)


def curve_keys(texts: pa.Array, ids: pa.Array | None = None) -> np.ndarray:
    """A key for each text: its place on the curve, then bits of a hash of its words, then bits of a hash of its id.

    The last parts copies, of which there may be more than a range should hold.
    """
    keys = [np.zeros(0, np.int64)]
    for _, _, data, offsets in slices(texts):
        starts, ends, first = words(data, offsets, SPACED_WORD)
        hashes = span_hashes(data, starts, ends, lowered=True)
        n = np.maximum(1, np.diff(first))
        points = np.zeros((len(n), DIMENSIONS), np.int64)
        for i in range(DIMENSIONS):
            signs = ((hashes >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(float) / 32768 - 1
            sums = np.concatenate([[0.0], np.cumsum(signs)])
            mean = (sums[first[1:]] - sums[first[:-1]]) / n
            points[:, i] = np.clip((np.tanh(6 * mean) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)])
        apart = mixed(total[first[1:]] - total[first[:-1]]) >> np.uint64(64 - 16)
        keys.append(hilbert_index(points) << 32 | apart.astype(np.int64) << 16)
    found = np.concatenate(keys)
    if ids is not None and len(found):
        own = np.asarray(pc.fill_null(ids, 0)).astype(np.uint64)
        found |= (mixed(own + np.uint64(1)) >> np.uint64(64 - 16)).astype(np.int64)
    return found


# ---------------------------------------------------------------- token ids


#: White space, and what some take for it, besides the space; up to the ninth in ASCII.
_ODD = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


class _Pieces(dict):
    """Ids of pieces of text, each after the given start, as bytes; filled as pieces come up.

    When it is full, the pieces met since the last time are kept aside, and those not met again until the next time go.
    """

    def __init__(self, encode, start: str, code: str) -> None:
        super().__init__()
        self.encode, self.start, self.code = encode, start, code
        self.aside: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.aside.get(piece)
        if ids is None:
            ids = array(self.code, self.encode(self.start + piece)).tobytes()
        if len(self) >= KEPT_PIECES:
            self.aside = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Token ids of whole texts, as 16- or 32-bit numbers.

    The byte-level tokenizer never joins a word with the space after it, so a text may be cut before any single space that
    stands between other characters than white space. The ids of the pieces are kept. A text with one of the `special`
    strings is encoded whole; a piece has none, so that the plain encoding does for it.
    """

    def __init__(self, own: tiktoken.Encoding, dtype: type, special: tuple[str, ...] = ()) -> None:
        self.dtype, self.special = dtype, special
        self.whole = functools.partial(own.encode, allowed_special="all") if special else own.encode_ordinary
        code = "H" if dtype is np.uint16 else "I"
        self.first, self.later = _Pieces(own.encode_ordinary, "", code), _Pieces(own.encode_ordinary, " ", code)

    def __call__(self, text: str) -> bytes:
        odd = [c for c in (_ODD[:9] if text.isascii() else _ODD) if c in text]
        if "  " in text or text[:1] == " " or text[-1:] == " " or any(f" {c}" in text or f"{c} " in text for c in odd) or any(s in text for s in self.special):
            return np.array(self.whole(text), self.dtype).tobytes()
        first, *later = text.split(" ")
        return self.first[first] + b"".join(map(self.later.__getitem__, later))


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def added_tokens(tokenizer: str) -> dict[str, int]:
    """The strings that a tokenizer's JSON file takes for one id each, wherever they stand in a text."""
    with open(tokenizer, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


def _id_type(vocabulary: dict[bytes, int], special: dict[str, int]) -> type:
    return np.uint16 if max([*vocabulary.values(), *special.values()]) < 1 << 16 else np.uint32


@functools.lru_cache(maxsize=1)
def _vocabulary(ranks: str, pattern: str, special: tuple[tuple[str, int], ...]) -> tuple[tiktoken.Encoding, type]:
    """A byte-level vocabulary, read once a worker, and the type its ids fit in."""
    vocabulary = _ranks(ranks)
    # The file of ranks may list special tokens as well: they are no product of merges then.
    ordinary = {token: rank for token, rank in vocabulary.items() if rank not in dict(special).values()} if special else vocabulary
    own = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ordinary, special_tokens=dict(special))
    return own, _id_type(vocabulary, dict(special))


def encoder(ranks: str, pattern: str, special: dict[str, int] | None = None) -> Encoder:
    """An encoder by a file of ranks and the pattern that parts words; the ids it keeps go with it.

    `special`: strings that are one id each; without them they are ordinary text.
    """
    special = special or {}
    own, dtype = _vocabulary(ranks, pattern, tuple(sorted(special.items())))
    return Encoder(own, dtype, tuple(special))


# ---------------------------------------------------------------- packing


def _encode_rows(ranks: str, pattern: str, special: dict[str, int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, pattern, special)
        end = np.array([END], encode.dtype).tobytes()
        for batch in in_parts(batches):
            texts = batch.column("text")
            ids = pa.array([encode(t or "") + end for t in texts.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(curve_keys(texts, batch.column("doc_id"))), ids], names=["doc_id", "key", "ids"])

    return rows


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
        yield pa.record_batch({"key": curve_keys(texts, batch.column("doc_id")), "bytes": sizes})


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(dtype: type):
    """Pieces of the sequences that a sorted range's tokens are cut into; only the open sequence is held."""

    def pack_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # pieces of the open sequence: id, start, ids, tokens of the document
        filled = 0

        def placed(pieces: list[tuple]) -> Iterator[tuple]:
            offset = 0
            for doc_id, start, ids, n in pieces:
                yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, sequence, offset
                offset += len(ids)

        def to_batch(out: list[tuple]) -> pa.RecordBatch:
            names = [part.split()[0] for part in _PIECES.split(", ")]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(ids.as_buffer(), dtype)
                start = 0
                while start < len(ids):
                    piece = ids[start : start + SEQUENCE - filled]
                    held.append((doc_id, start, piece, len(ids)))
                    start, filled = start + len(piece), filled + len(piece)
                    if filled == SEQUENCE:
                        out.extend(placed(held))
                        held, filled, sequence = [], 0, sequence + 1
            yield to_batch(out)
        out = []
        while filled:
            room = 1 << (filled.bit_length() - 1)  # the largest power of two that can be filled
            filled, own, rest = filled - room, [], []
            for doc_id, start, ids, n in held:
                if room:
                    own.append((doc_id, start, ids[:room], n))
                if len(ids) > room:
                    rest.append((doc_id, start + room, ids[room:], n))
                room = max(0, room - len(ids))
            out.extend(placed(own))
            held, sequence = rest, sequence + 1
        yield to_batch(out)

    return pack_range


def pack(documents: DataFrame, ranks: str, pattern: str, special: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document.

    Each document's ids, with id 0 at the end, are cut into pieces that lie in one sequence each; pieces of a sequence join
    without gaps. Sequences have SEQUENCE tokens, or a power of two at the end of a range. Null and empty texts have the
    one id 0. Rows that repeat a doc_id are packed each on its own; other columns are ignored; an empty table gives no rows.

    `ranks` and `pattern`: file and word pattern of a byte-level vocabulary; the file must be there on every executor.
    `special`: strings that are one id each wherever they stand; without them they are ordinary text.
    """
    special = special or {}
    documents = documents.select("doc_id", "text")
    # Where ranges end decides on the layout only, so a sample by hash will do; the texts are encoded once.
    sample = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).mapInArrow(_key_rows, "key long, bytes long")
    # One literal: an array of them would go to the JVM number by number.
    shares = F.split(F.lit(",".join(repr(i / RANGE_STEPS) for i in range(1, RANGE_STEPS))), ",").cast("array<double>")
    found, size = sample.agg(F.percentile_approx("key", shares, 10 * RANGE_STEPS), F.sum("bytes")).first()
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = min(RANGE_STEPS, max(partitions, (size or 0) * SAMPLED // RANGE_BYTES))
    found = [found[i * RANGE_STEPS // partitions - 1] for i in range(1, partitions)] if found else []
    bounds = np.array(sorted(set(found)), np.int64)

    def with_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _encode_rows(ranks, pattern, special)(batches):
            found = np.searchsorted(bounds, np.asarray(batch.column("key")), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "range"])

    encoded = documents.mapInArrow(with_range, "doc_id long, key long, ids binary, range int")
    rows = encoded.repartitionById(partitions, "range").sortWithinPartitions("key", "doc_id", "ids")
    dtype = _id_type(_ranks(ranks), special)
    return rows.mapInArrow(_pack(dtype), _PIECES)
