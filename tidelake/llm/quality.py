"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features interacts through the inner product of their low-rank factors; the sum over all pairs of a text is
had in linear time as half of (square of sums less sum of squares), per factor. Features are a bag of hashed words with
unit length, and statistics of the text's structure and its stated length, each as one of a few bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType

from tidelake.llm._common import SPACED_WORD, slices, span_hashes, training_rows, widened, words

#: Labelled rows that the machine is fitted on, at most.
MAX_ROWS = 8_000
#: Cells of hashed words, bins of a statistic, rank of the interactions.
CELLS, BINS, RANK = 1 << 13, 16, 8
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.02, 1e-4

#: Classes of bytes whose shares are statistics.
_CLASS = np.zeros(256, np.int64)
for _n, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"#$%&*@^~=+", b"|<>{}[]()/_-\"'`\\", b" \t", b"\r\n", bytes(range(128, 256))), 1):
    _CLASS[list(_chars)] = _n
N_CLASSES = 11
#: Statistics: shares of byte classes; words, their mean length, distinct and most frequent share; length in characters, as stated.
N_STATISTICS = N_CLASSES + 5
SIZE = CELLS + N_STATISTICS * BINS + 1


def _bin_share(share: np.ndarray) -> np.ndarray:
    """Bins that are finer for small shares: halves of halves down to 1 in 2**14, and none."""
    return np.where(share > 0, np.clip(BINS - 1 + np.ceil(np.log2(np.maximum(share, 1e-9))), 1, BINS - 1), 0).astype(np.int64)


def _bin_size(n: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 1, np.ceil(np.log2(n + 1)).astype(np.int64))


def features(texts: pa.Array, n_chars: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By run of rows: first row, offsets of each row's features, their numbers (ascending in a row) and values."""
    stated = np.array([-1 if n is None else max(n, 0) for n in n_chars.to_pylist()], np.int64)
    for low, high, data, offsets in slices(texts):
        n = high - low
        starts, ends, first = words(data, offsets, SPACED_WORD)
        n_words = np.diff(first)
        row = np.repeat(np.arange(n), n_words)
        bag = row * CELLS + (span_hashes(data, starts, ends, lowered=True) % np.uint64(CELLS)).astype(np.int64)
        bag, times = np.unique(bag, return_counts=True)
        bag_row = bag // CELLS
        distinct = np.bincount(bag_row, minlength=n)
        most = np.zeros(n, np.int64)
        np.maximum.at(most, bag_row, times)
        length = np.sqrt(np.bincount(bag_row, times.astype(float) ** 2, n))
        n_bytes = np.diff(offsets)
        shares = np.bincount(np.repeat(np.arange(n) * N_CLASSES, n_bytes) + _CLASS[data], minlength=n * N_CLASSES).reshape(n, -1)
        some = np.maximum(1, n_words)
        bins = np.column_stack(
            [
                _bin_share(shares / np.maximum(1, n_bytes)[:, None]),
                _bin_size(n_words),
                np.minimum(BINS - 1, (np.bincount(row, ends - starts, n) / some).astype(np.int64)),
                np.minimum(BINS - 1, (distinct / some * BINS).astype(np.int64)),
                _bin_share(most / some),
                np.where(stated[low:high] < 0, BINS - 1, np.minimum(BINS - 2, _bin_size(np.maximum(stated[low:high], 0)) // 2)),
            ]
        )
        numbers = np.concatenate([bag % CELLS, (CELLS + np.arange(N_STATISTICS) * BINS + bins).ravel()])
        values = np.concatenate([times / length[bag_row], np.full(n * N_STATISTICS, 1 / np.sqrt(N_STATISTICS))])
        of = np.concatenate([bag_row, np.repeat(np.arange(n), N_STATISTICS)])
        order = np.argsort(of, kind="stable")
        yield low, np.concatenate([[0], np.cumsum(distinct + N_STATISTICS)]), numbers[order], values[order].astype(np.float32)


@dataclass(frozen=True)
class Machine:
    bias: float
    linear: np.ndarray  # [SIZE]
    factors: np.ndarray  # [SIZE, RANK]


def margins(machine: Machine, offsets: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The machine's output before the logistic function, of each row; each row has features."""
    if len(offsets) < 2:
        return np.zeros(0)
    own = machine.factors[numbers] * values[:, None]
    sums = np.add.reduceat(own, offsets[:-1])
    pairs = (sums**2 - np.add.reduceat(own**2, offsets[:-1])).sum(axis=1) / 2
    return machine.bias + np.add.reduceat(machine.linear[numbers] * values, offsets[:-1]) + pairs


def train(labels: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], seed: int = 7) -> Machine:
    """Logistic loss, minibatches, Adam. Without rows of both labels, the bias alone."""
    rng = np.random.default_rng(seed)
    y = labels.astype(np.float32)
    rate = (y.sum() + 1) / (len(y) + 2)
    w, v = np.zeros(SIZE, np.float32), rng.normal(0, 0.05, (SIZE, RANK)).astype(np.float32)
    bias = np.array([np.log(rate / (1 - rate))], np.float32)
    if len(np.unique(y)) < 2:
        return Machine(float(bias[0]), w, np.zeros_like(v))
    params, moments, step = [bias, w, v], [], 0
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    weight = np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate)).astype(np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            chosen = order[at : at + BATCH]
            x = np.zeros((len(chosen), SIZE), np.float32)
            for i, r in enumerate(chosen):
                x[i, rows[r][0]] = rows[r][1]
            sums, squares = x @ v, x**2
            z = bias + x @ w + ((sums**2) - squares @ (v**2)).sum(axis=1) / 2
            delta = weight[chosen] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chosen]) / len(chosen)
            slopes = [
                np.array([delta.sum()], np.float32),
                x.T @ delta + DECAY * w,
                x.T @ (delta[:, None] * sums) - v * (squares.T @ delta)[:, None] + DECAY * v,
            ]
            step += 1
            for p, g, (m1, m2) in zip(params, slopes, moments, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                p -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Machine(float(bias[0]), w, v)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column("label").cast(pa.int32())
        for low, offsets, numbers, values in features(batch.column("text"), batch.column("n_chars")):
            at = pa.array(offsets.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    labels.slice(low, len(offsets) - 1),
                    pa.ListArray.from_arrays(at, pa.array(numbers.astype(np.int32))),
                    pa.ListArray.from_arrays(at, pa.array(values)),
                ],
                names=["label", "numbers", "values"],
            )


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Machine:
    """A machine from at most `max_rows` labelled rows that are not held out, with their whole texts."""
    sample = training_rows(documents, labels, label, max_rows, "n_chars").select("text", "label", "n_chars")
    rows = sample.mapInArrow(_feature_rows, "label int, numbers array<int>, values array<float>").toArrow()
    parts = [(np.asarray(n.values), np.asarray(v.values)) for n, v in zip(rows["numbers"], rows["values"], strict=True)]
    return train(np.asarray(rows["label"]), parts)


def score_documents(documents: DataFrame, machine: Machine, into: str = "quality_score") -> DataFrame:
    """The frame with the score (0 to 1) of its `text` and `n_chars` as a further column, called `into`.

    Null and empty texts have no words and are scored by their statistics, a null length has a bin of its own. Repeated rows
    are scored alike, each on its own. An empty table gives an empty one.
    A column that is named like `into` is replaced.
    """
    documents = documents.drop(into)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
            scores = np.zeros(batch.num_rows)
            for low, offsets, numbers, values in features(column("text"), column("n_chars")):
                z = margins(machine, offsets, numbers, values)
                scores[low : low + len(z)] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, into])

    return documents.mapInArrow(score, widened(documents, **{into: DoubleType()}))
