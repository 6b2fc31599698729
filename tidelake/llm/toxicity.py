"""Toxicity of texts whose words may be disguised: noisy-channel restoration, then a score of the restored words.

A disguised word (digits and signs for letters, letters pulled apart, letters repeated) is read as a lattice: at each
character the channel may have replaced, repeated or inserted something, at a cost. Viterbi decoding under a character
language model of the whole corpus picks the word. Words of letters only have a single path and stay as they are.

The score comes from restored words and their openings. Sequential covering of labelled rows chooses them: the most
reliable feature is taken, what it covers is set aside, and the rest is counted anew, so that words which merely go along
with toxic ones are left out. A logistic regression weighs how often and how densely the chosen ones are met.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidelake.llm._common import SLICE_BYTES, SPACED_WORD, hashes_between, in_parts, mixed, prefix_sums, slices, training_rows, widened, words

#: Labelled rows that the score is learned from, at most.
MAX_ROWS = 4_500
#: Features are hashed into this many cells.
CELLS = 1 << 22
#: A feature's reliability is its share of toxic rows, with this many clean ones added; below the least it isn't chosen.
DOUBT, LEAST = 2.0, 0.6
PENALTY = 0.05
#: Features with this reliability that at least this share of toxic rows has are taken even if others cover them.
RELIABLE, COMMON = 0.8, 0.03
#: A feature counts up to this often, and up to this many times in a hundred words.
LEVELS = 4
#: Decoded words a Python worker keeps; more are decoded again.
KEPT_WORDS = 100_000

# The letters that digits and signs stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Signs that may hide any vowel.
MASKS = "*#"
VOWELS = "aeiou"
#: Costs of the channel, in nats: a replaced letter, a masked one, a repetition, a dropped sign, a sign read as a gap.
REPLACED, MASKED, REPEATED, DROPPED, PARTED = 0.5, 2.0, 0.5, 1.5, 3.0
#: Cost of a sign or digit that is just that: one of about twenty.
LITERAL = 3.0
#: Readings that are kept at each step of the decoding.
BEAM = 24

#: Symbols of the language model: 0 for what parts words, 1 to 26 for letters, 27 to 31 for others by their last byte.
SYMBOLS = 32
_SYMBOL = np.zeros(256, np.uint8)
for _i in range(26):
    _SYMBOL[97 + _i] = _SYMBOL[65 + _i] = _i + 1
for _i in range(0x80, 0xC0):
    _SYMBOL[_i] = 27 + _i % 5

_TRAILING = ".,;:?\"')]}%&*#|"
_LEADING = "\"'([{%&*#|"
_ONE = r"[^\W_@$!|+(<€£¡*#]|[@$!|+(<€£¡*#]"
_APART = re.compile(rf"(?<!\S)(?:(?:{_ONE})\s+){{2,}}(?:{_ONE})(?!\S)")
_ONE = re.compile(_ONE)
#: What may stand between words of one token.
_MARKS = re.compile(r"[^\w@$!|+(<€£¡*#]|_")
#: Letters that come thrice, or two doubled ones in a row, or three doubled ones anywhere.
_STRETCHED = re.compile(r"([^\W\d_])\1\1|([^\W\d_])\2([^\W\d_])\3|(?:([^\W\d_])\4.*?){3}")
_LETTERS = re.compile(r"[^\W\d_]+")
_DECORATION = re.compile(r"([$+@])\1{2,}$|!+$")


# ---------------------------------------------------------------- language model


def _symbols(data: np.ndarray) -> np.ndarray:
    return _SYMBOL[data[data < 0xC0]]


def _codes(symbols: np.ndarray) -> np.ndarray:
    """Of each symbol that continues or ends a word: the three before it in the word, and itself, as one number."""
    padded = np.concatenate([np.zeros(3, np.uint8), symbols, np.zeros(1, np.uint8)]).astype(np.int32)
    now, back1, back2, back3 = padded[3:], padded[2:-1].copy(), padded[1:-2].copy(), padded[:-3].copy()
    back2[back1 == 0] = 0
    back3[back2 == 0] = 0
    return ((back3 << 15) | (back2 << 10) | (back1 << 5) | now)[(now > 0) | (back1 > 0)]


def _count_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SYMBOLS**4, np.int64)
    for batch in batches:
        for _, _, data, offsets in slices(batch.column("text"), 4 * SLICE_BYTES):
            # A gap after each text keeps the words of neighbours apart.
            codes = _codes(_symbols(np.insert(data, offsets[1:], 0x20)))
            counts += np.bincount(codes, minlength=SYMBOLS**4)
    code = np.flatnonzero(counts)
    yield pa.record_batch({"code": code.astype(np.int32), "n": counts[code]})


def language_model(documents: DataFrame) -> np.ndarray:
    """Log-probability of a symbol after three others, [32, 32, 32, 32], smoothed by lower orders; from all texts."""
    counted = documents.select("text").mapInArrow(_count_codes, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()  # 32 ** 4 rows at most
    counts = np.zeros(SYMBOLS**4)
    counts[np.asarray(rows["code"])] = np.asarray(rows["n"])
    counts = counts.reshape([SYMBOLS] * 4)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(4):
        n = counts.sum(axis=tuple(range(3 - order)))
        p = (n + 4 * p) / (n.sum(axis=-1, keepdims=True) + 4)
    return np.log(p).astype(np.float32)


# ---------------------------------------------------------------- restoring


def _symbol_of(char: str) -> int:
    return int(_SYMBOL[char.encode()[-1]])


def _best(token: str, logp: np.ndarray, whole: bool = False) -> tuple[float, str]:
    """The likeliest reading of a disguised token, which may be several words, after its cost; `whole`: with no letter left out."""
    table = memoryview(logp).cast("B").cast("f")  # plain floats, with the four symbols as one number
    # A state is the last three symbols, as a number, and the last letter; of readings that share it the best goes on.
    states: dict[tuple[int, str], tuple[float, str]] = {(0, ""): (0.0, "")}
    for char in token:
        plain = char.isalpha()
        letters = [(char, 0.0)] if plain else [(x, REPLACED) for x in LEET.get(char, "")]
        if char in MASKS:
            letters += [(x, MASKED) for x in VOWELS]
        letters = [(x, _symbol_of(x), more) for x, more in letters]
        drop = 0.0 if char.isspace() else DROPPED
        plain = plain or whole and char in LEET
        step: dict[tuple[int, str], tuple[float, str]] = {}
        for (back, last), (cost, text) in states.items():
            for letter, symbol, more in letters:
                now = back << 5 | symbol
                key, total = (now & 0x7FFF, letter), cost + more - table[now]
                if key not in step or total < step[key][0]:
                    step[key] = (total, text + letter)
                if letter == last:
                    key, total = (back, last), cost + more + REPEATED
                    if key not in step or total < step[key][0]:
                        step[key] = (total, text)
            if not plain:
                key, total = (back, last), cost + drop
                if key not in step or total < step[key][0]:
                    step[key] = (total, text)
                if back & 31:
                    key, total = (0, ""), cost + PARTED - table[back << 5]
                    if key not in step or total < step[key][0]:
                        step[key] = (total, text + " ")
        states = dict(sorted(step.items(), key=lambda x: x[1])[:BEAM]) if len(step) > BEAM else step
    ended = ((cost - (table[back << 5] if back & 31 else 0.0), text) for (back, _), (cost, text) in states.items())
    cost, text = min(ended, default=(0.0, token))
    return cost, text.strip()


def decode(token: str, logp: np.ndarray) -> str:
    """The likeliest reading of a disguised token, which may be several words."""
    return _best(token, logp)[1]


def read(token: str, logp: np.ndarray) -> str:
    """As decoded; a reading of all signs and digits as letters goes first, if it costs less than to take them literally."""
    signs = sum(char in LEET for char in token)
    if signs:
        cost, text = _best(token, logp, whole=True)
        if cost < LITERAL * signs + sum(_best(run, logp)[0] for run in _LETTERS.findall(token)):
            return text
    return decode(token, logp)


def restore_token(token: str, logp: np.ndarray) -> str:
    """A lower-case token's words, parted by spaces and decoded where they are disguised; empty if it has no letters.

    A token is disguised if letters repeat thrice or are doubled one after the other, if it has signs or digits that may
    stand for letters, or if marks part it into pieces of a few letters. Other marks part it into words. That signs and
    digits are just these, and no letters, is one of the readings whose costs are compared.
    """
    if token.isalpha() and not _STRETCHED.search(token):
        return token
    core = _DECORATION.sub("", token.lstrip(_LEADING).rstrip(_TRAILING)).rstrip(_TRAILING)
    if core.isalpha() and not _STRETCHED.search(core):
        return core
    pieces = [x for x in _MARKS.split(core) if x]
    if len(pieces) > 1 and max(map(len, pieces)) <= 3:
        pieces = [core]  # pulled apart
    found = []
    for piece in pieces:
        plain = piece.isalpha() and not _STRETCHED.search(piece)
        found.append(piece if plain else read(piece, logp))
    return " ".join(filter(None, found))


def restore(text: str | None, logp: np.ndarray) -> str:
    """The text's words, restored and lower-cased, parted by single spaces; a null is an empty text."""
    text = (text or "").lower()
    found, last = [], 0
    for run in _APART.finditer(text):
        found += [restore_token(t, logp) for t in text[last : run.start()].split()]
        found.append(read(" ".join(run[0].split()), logp))
        last = run.end()
    found += [restore_token(t, logp) for t in text[last:].split()]
    return " ".join(filter(None, found))


# ---------------------------------------------------------------- features


#: Openings of words that are features, in bytes.
OPENINGS = range(8, 2, -1)
_WHOLE = np.uint64(0x5851F42D4C957F2D)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_IS_ONE = np.array([i < 128 and _ONE.fullmatch(chr(i)) is not None for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_TRAILING, _IS_LEADING = np.zeros(256, bool), np.zeros(256, bool)
_IS_TRAILING[list(_TRAILING.encode())] = True
_IS_LEADING[list(_LEADING.encode())] = True


def _lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 with A-Z and the capitals of Latin-1 in lower case."""
    data = _LOWER[data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[capital] += 0x20
    return data


class _Restored(dict):
    """Restored words by token or by run of single characters parted by spaces, as UTF-8; filled as they come up."""

    def __init__(self, logp: np.ndarray) -> None:
        super().__init__()
        self.logp = logp

    def __missing__(self, token: bytes) -> bytes:
        text = token.decode(errors="replace")
        found = (read if " " in text else restore_token)(text, self.logp).encode()
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[token] = found
        return found


def _plain_words(data: np.ndarray, row: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, end) of the words of letters only, then (text, start, end) of the other tokens."""
    inner_starts, inner_ends = starts.copy(), ends.copy()
    for _ in range(4):  # what surrounds a word; with more of it, a token is looked at on its own
        inner_ends -= _IS_TRAILING[data[inner_ends - 1]] & (inner_ends > inner_starts + 1)
        inner_starts += _IS_LEADING[data[np.minimum(inner_starts, len(data) - 1)]] & (inner_ends > inner_starts + 1)
    letter = _LETTER[data]
    # A letter that comes thrice, two or three that are doubled, or a character that isn't one, make a token one to look at.
    double, odd = np.zeros(len(data), bool), ~letter
    double[1:] = letter[1:] & (data[1:] == data[:-1])
    odd[2:] |= double[2:] & double[1:-1]
    odd[3:] |= double[3:] & double[1:-2]
    upto, doubles = (np.concatenate([[0], np.cumsum(x)]) for x in (odd, double))
    plain = upto[inner_ends] == upto[np.minimum(inner_starts + 2, inner_ends)]
    plain &= doubles[inner_ends] - doubles[np.minimum(inner_starts + 1, inner_ends)] < 3
    plain &= letter[inner_starts] & letter[inner_ends - 1] & letter[np.minimum(inner_starts + 1, inner_ends - 1)]
    return row[plain], inner_starts[plain], inner_ends[plain], row[~plain], starts[~plain], ends[~plain]


def _apart_runs(data: np.ndarray, row: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[tuple[int, bytes]], np.ndarray]:
    """(text, run) of three or more tokens of one letter, digit or sign that follow each other, and which tokens are in runs."""
    lead, size = data[starts], ends - starts
    single = _IS_ONE[lead] & (size == 1) | (lead >= 0xC2) & (lead < 0xE0) & (size == 2) | (lead >= 0xE0) & (lead < 0xF0) & (size == 3) | (lead >= 0xF0) & (size == 4)
    raw, far = memoryview(data), np.flatnonzero(single & (lead >= 0x80))
    single[far] = [_ONE.fullmatch(bytes(raw[a:b]).decode(errors="replace")) is not None for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
    at = np.flatnonzero(single)
    joins = (np.diff(at) == 1) & (row[at[1:]] == row[at[:-1]])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], joins.view(np.int8), [0]])))
    runs, inside = [], np.zeros(len(starts), bool)
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if b - a >= 2:
            first, last = at[a], at[b]
            inside[first : last + 1] = True
            runs.append((int(row[first]), b" ".join(data[starts[first] : ends[last]].tobytes().split())))
    return runs, inside


def _cells(data: np.ndarray, row: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rank, text, cell) of the features of words: whole words have rank 0, openings from the longest ranks 1 to 6."""
    sums = prefix_sums(data)
    yield 0, row, (mixed(hashes_between(sums, starts, ends) ^ _WHOLE) % np.uint64(CELLS)).astype(np.int64)
    for rank, n in enumerate(OPENINGS, 1):
        long = ends - starts >= n
        yield rank, row[long], (hashes_between(sums, starts[long], starts[long] + n) % np.uint64(CELLS)).astype(np.int64)


def features(column: pa.Array, restored: _Restored) -> Iterator[tuple[int, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]]:
    """By run of texts: the first, the number of words of each, and (rank, text, cell) of all words' features."""
    for low, _, data, offsets in slices(column):
        data = _lowered(data)
        starts, ends, first = words(data, offsets, SPACED_WORD)
        n_words = np.diff(first)
        row = np.repeat(np.arange(len(n_words)), n_words)
        runs, inside = _apart_runs(data, row, starts, ends)
        row, starts, ends, odd_row, odd_starts, odd_ends = _plain_words(data, row[~inside], starts[~inside], ends[~inside])
        found = list(_cells(data, row, starts, ends))
        raw = memoryview(data)
        more = [(i, restored[bytes(raw[a:b])]) for i, a, b in zip(odd_row.tolist(), odd_starts.tolist(), odd_ends.tolist(), strict=True)]
        more += [(i, restored[run]) for i, run in runs]
        if more:
            texts = np.frombuffer(b" ".join(text for _, text in more), np.uint8)
            token = np.concatenate([[0], np.cumsum([len(text) + 1 for _, text in more])])
            token[-1] = len(texts)
            starts, ends, first = words(texts, token, SPACED_WORD)
            found += _cells(texts, np.repeat([i for i, _ in more], np.diff(first)), starts, ends)
        yield low, np.maximum(1, n_words), found


# ---------------------------------------------------------------- learning and scoring


@dataclass(frozen=True)
class ToxicModel:
    logp: np.ndarray
    weights: dict[int, tuple[float, float]]  # by cell: for how often it is met, for how dense that is
    bias: float


def _strengths(n: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often and how densely a cell is met, both 0 to 1."""
    return np.minimum(n, LEVELS) / LEVELS, np.minimum(100 * n / n_words, LEVELS) / LEVELS


def scores(column: pa.Array, model: ToxicModel, restored: _Restored | None = None) -> np.ndarray:
    """The logistic function of the weights of what each restored text meets; where it meets nothing, of the bias."""
    restored = _Restored(model.logp) if restored is None else restored
    cells = np.array(sorted(model.weights), np.int64)
    weights = np.array([model.weights[c] for c in cells.tolist()]).reshape(-1, 2)
    wanted = np.zeros(CELLS, bool)
    wanted[cells] = True
    z = np.full(len(column), model.bias)
    for low, n_words, found in features(column, restored) if len(cells) else ():
        met = np.zeros(len(n_words) * len(cells))
        for _, row, cell in found:
            hit = np.flatnonzero(wanted[cell])
            met += np.bincount(row[hit] * len(cells) + np.searchsorted(cells, cell[hit]), minlength=len(met))
        often, dense = _strengths(met.reshape(-1, len(cells)), n_words[:, None])
        z[low : low + len(n_words)] += often @ weights[:, 0] + dense @ weights[:, 1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_text(text: str | None, model: ToxicModel) -> float:
    return float(scores(pa.array([text], pa.string()), model)[0])


def _feature_rows(logp: np.ndarray):
    """Of each labelled text its number of words and, once for each time up to LEVELS that it is met, each feature."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored = _Restored(logp)
        for batch in batches:
            labels = batch.column("label").cast(pa.int32())
            for low, n_words, found in features(batch.column("text"), restored):
                keys = np.concatenate([row * (CELLS * 8) + cell * 8 + rank for rank, row, cell in found])
                keys, times = np.unique(keys, return_counts=True)
                times = np.minimum(times, LEVELS)
                level = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                keys = np.repeat(keys, times)
                met = (keys % (CELLS * 8) * 4 + level).astype(np.int32)
                offsets = np.searchsorted(keys // (CELLS * 8), np.arange(len(n_words) + 1)).astype(np.int32)
                yield pa.record_batch(
                    {
                        "label": labels.slice(low, len(n_words)),
                        "n_words": pa.array(n_words.astype(np.int64)),
                        "met": pa.ListArray.from_arrays(pa.array(offsets), pa.array(met)),
                    }
                )

    return rows


def choose_cells(toxic: np.ndarray, row: np.ndarray, names: np.ndarray, column: np.ndarray) -> list[int]:
    """The cells that tell toxic rows, by sequential covering. A feature is met at (row, names[column]).

    The next feature is always the most reliable one over the rows not yet covered, with its reliability over all rows as
    what is known beforehand; of equals, the most specific. So a feature that merely goes along with others is left out. Words
    and openings of five letters or more that are reliable over all rows, and common in toxic ones, are in any case taken.
    """
    count = lambda rows: np.bincount(column[rows[row]], minlength=len(names))
    yes, no = count(toxic), count(~toxic)
    reliable = yes / (yes + no + DOUBT)
    before = reliable**2
    open_rows, chosen = np.ones(len(toxic), bool), list(names[(yes >= COMMON * toxic.sum()) & (reliable >= RELIABLE) & ((names & 31) < 20)] >> 5)
    while len(names):
        yes, no = count(open_rows & toxic), count(open_rows & ~toxic)
        sure = np.where(yes > 0, (yes + 2 * DOUBT * before) / (yes + no + 2 * DOUBT), 0).round(6)
        equal = np.flatnonzero(sure == sure.max())
        best = int(equal[np.lexsort((names[equal], names[equal] & 31))[0]])
        if sure[best] < LEAST:
            break
        chosen.append(names[best] >> 5)
        open_rows[row[column == best]] = False
    return sorted({int(c) for c in chosen})


def _told(toxic: np.ndarray, met: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, names, column) of the features that could tell toxic rows: those met in a few, and not mostly in clean ones."""
    names, n = np.unique(np.concatenate([m for m, t in zip(met, toxic, strict=True) if t]), return_counts=True)
    names = names[n / (n + DOUBT) >= LEAST]
    rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(met) if len(names) else 0, 256):
        part = met[at : at + 256]
        row, flat = np.repeat(np.arange(at, at + len(part)), [len(m) for m in part]), np.concatenate(part)
        column = np.minimum(np.searchsorted(names, flat), len(names) - 1)
        known = names[column] == flat
        rows.append(row[known])
        columns.append(column[known])
    row, column = np.concatenate(rows), np.concatenate(columns)
    share = np.bincount(column[toxic[row]], minlength=len(names)) / np.maximum(1, np.bincount(column, minlength=len(names)))
    kept = share >= LEAST / 2
    column, row = (np.cumsum(kept) - 1)[column][kept[column]], row[kept[column]]
    return row, names[kept], column


def learn(labels: np.ndarray, n_words: np.ndarray, met: list[np.ndarray]) -> tuple[dict[int, tuple[float, float]], float]:
    """Weights by cell and the bias: logistic regression with a small penalty over the chosen cells, by Newton's steps.

    Without toxic rows there are no weights.
    """
    toxic = labels == 1
    y = toxic.astype(float)
    bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if not toxic.any():
        return {}, bias
    row, names, column = _told(toxic, met)
    cells = np.array(choose_cells(toxic, row, names, column), np.int64)
    often = np.zeros((len(y), len(cells)))
    for i, m in enumerate(met):
        found, n = np.unique(m >> 5, return_counts=True)
        at = np.isin(found, cells)
        often[i, np.searchsorted(cells, found[at])] = n[at]
    x = np.hstack([np.ones((len(y), 1)), *_strengths(often, n_words[:, None])])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), PENALTY)
    penalty[0] = 1e-6
    w[0] = bias
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + (penalty * w**2).sum() / 2
    for _ in range(30 if len(cells) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), slope)
        size = next((h for h in 0.5 ** np.arange(20) if loss(w - h * step) < loss(w)), 0.0)
        w -= size * step
        if size * np.abs(step).max() < 1e-6:
            break
    n = len(cells)
    return {int(c): (float(a), float(b)) for c, a, b in zip(cells, w[1 : n + 1], w[n + 1 :], strict=True)}, float(w[0])


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> ToxicModel:
    """Language model of all texts; weights from at most `max_rows` labelled rows that are not held out."""
    logp = language_model(documents)
    sample = training_rows(documents, labels, "toxic", max_rows).select("text", "label")
    rows = sample.mapInArrow(_feature_rows(logp), "label int, n_words long, met array<int>").toArrow()
    weights, bias = learn(np.asarray(rows["label"]), np.asarray(rows["n_words"]), [np.asarray(m.values) for m in rows["met"]])
    return ToxicModel(logp, weights, bias)


def score_documents(documents: DataFrame, model: ToxicModel, into: str = "toxic_score") -> DataFrame:
    """The frame with the score (0 to 1) of its `text` as a further column, called `into`, whatever other columns there are.

    Null and empty texts get the score of a text that meets nothing. Repeated rows are scored alike, each on its own.
    A column that is named like `into` is replaced.
    """
    documents = documents.drop(into)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored = _Restored(model.logp)
        for batch in batches:
            found = scores(batch.column(batch.schema.get_field_index("text")), model, restored)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, into])

    return documents.mapInArrow(score, widened(documents, **{into: DoubleType()}))


def keep_clean(documents: DataFrame, model: ToxicModel, threshold: float = 0.3) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored = _Restored(model.logp)
        for batch in in_parts(batches):
            found = scores(batch.column(batch.schema.get_field_index("text")), model, restored)
            yield batch.filter(pa.array(found < threshold))

    return documents.mapInArrow(keep, documents.schema)
