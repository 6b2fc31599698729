"""Repair of the structure of conversations: the cheapest edits that make roles alternate, by tables over blocks of turns.

A turn is a symbol: what its role starts with, and whether it must go, is cut short, or is sound. Role initials must read
`(s?(ua)+)?`, so a repair is a walk through four states. What the rest of a conversation costs from each state is a vector of
four numbers; less its smallest, only a few vectors ever occur. For each of them and each block of BLOCK symbols a table says
which vector stands before the block and by how much the smallest has grown. A conversation is read from its end, a block
a lookup; then blocks are expanded from its start, and among the cheapest edits the one with the least letter is taken at
each step. Letters and states decide on all that follows, so ties are broken as if whole strings were compared.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm._common import widened

#: Symbols of a block.
BLOCK = 3
#: Bytes of turns of the conversation at hand that are held; more go to a file of the task.
HELD_BYTES = 32 << 20
#: Costs of edits, and of a truncated turn that stays.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: White space.
BLANK = " \t\n\x0b\x0c\r"

# States: nothing yet, after the system's turn, after a user's, after an assistant's.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_ROLE_AFTER = {_START: "user", _SYSTEM: "user", _USER: "assistant", _ASSISTANT: "user"}
_AFTER_ROLE = {"user": _USER, "assistant": _ASSISTANT}
#: What the end of a conversation costs: nothing, or the turns that are missing.
_END = (0, 2 * INSERT, INSERT, 0)
_NONE = 1 << 40

# Symbols: no turn (fills the first block), one that must go, and roles s, u, a, other, sound or truncated.
_PAD, _GONE = 0, 1
_SOUND = {"s": 2, "u": 3, "a": 4}
_OTHER, _SYMBOLS = 5, 10


def _initial(symbol: int) -> str:
    return "sua-"[(symbol - 2) % 4]


def _kept(state: int, symbol: int) -> int | None:
    """The state after a turn is kept, if it may be."""
    initial = _initial(symbol)
    if initial == "s":
        return _SYSTEM if state == _START else None
    return _AFTER_ROLE[_ROLE_AFTER[state]] if initial == _ROLE_AFTER[state][0] else None


def _edits(state: int, symbol: int, before: list[int] | tuple[int, ...], after: tuple[int, ...]) -> Iterator[tuple[str, int, int]]:
    """(letter, cost of the whole rest, next state) of what can be done at a turn; by letter. `before` is for inserts."""
    yield "D", DELETE + after[state], state
    following = _AFTER_ROLE[_ROLE_AFTER[state]]
    yield "I", INSERT + before[following], following
    if symbol != _GONE:
        extra = TRUNCATED if symbol >= _OTHER + 1 else 0
        kept = _kept(state, symbol)
        if kept is not None:
            yield "K", extra + after[kept], kept
        yield "R", REROLE + extra + after[following], following


def _step(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The costs before a turn from those after it."""
    if symbol == _PAD:
        return after
    none = [_NONE] * 4
    costs = [min(cost for _, cost, _ in _edits(state, symbol, none, after)) for state in range(4)]
    for _ in range(3):  # inserts lead from state to state
        costs = [min(costs[state], INSERT + costs[_AFTER_ROLE[_ROLE_AFTER[state]]]) for state in range(4)]
    return tuple(costs)


def _normal(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(c - least for c in costs), least


class BlockTables:
    """For each vector that occurs and each block: the vector before the block, and what the smallest cost has grown by."""

    def __init__(self, size: int = BLOCK) -> None:
        self.size = size
        self.vectors: list[tuple[int, ...]] = [_normal(_END)[0]]
        single: dict[tuple[int, int], tuple[int, int]] = {}
        number = {self.vectors[0]: 0}
        for v in itertools.takewhile(lambda v: v < len(self.vectors), itertools.count()):
            for symbol in range(_SYMBOLS):
                before, grown = _normal(_step(symbol, self.vectors[v]))
                if before not in number:
                    number[before] = len(self.vectors)
                    self.vectors.append(before)
                single[v, symbol] = number[before], grown
        self.before = [[0] * _SYMBOLS**size for _ in self.vectors]
        self.grown = [[0] * _SYMBOLS**size for _ in self.vectors]
        for v in range(len(self.vectors)):
            for code, block in enumerate(itertools.product(range(_SYMBOLS), repeat=size)):
                at, total = v, 0
                for symbol in reversed(block):
                    at, grown = single[at, symbol]
                    total += grown
                self.before[v][code], self.grown[v][code] = at, total
        self._expanded: dict[tuple[int, int, int], tuple[str, int]] = {}

    def _expand(self, v: int, code: int, state: int) -> tuple[str, int]:
        """The letters of a block's edits, from a state before it to the costs `v` after it, and the state after it."""
        found = self._expanded.get((v, code, state))
        if found is None:
            block = [code // _SYMBOLS**i % _SYMBOLS for i in reversed(range(self.size))]
            costs = [self.vectors[v]]
            for symbol in reversed(block):
                costs.append(_step(symbol, costs[-1]))
            costs.reverse()
            letters, at = [], state
            for i, symbol in enumerate(block):
                while symbol != _PAD:
                    letter, at = next((x, to) for x, cost, to in _edits(at, symbol, costs[i], costs[i + 1]) if cost == costs[i][at])
                    letters.append(letter)
                    if letter != "I":
                        break
            found = self._expanded[v, code, state] = "".join(letters), at
        return found

    def cheapest(self, symbols: bytes | bytearray) -> tuple[int, str]:
        """The cost of the cheapest edits of a sequence of symbols and their letters, the ASCII-least of all cheapest."""
        fill = -len(symbols) % self.size
        padded = bytes(fill) + bytes(symbols)
        codes = [functools.reduce(lambda c, s: c * _SYMBOLS + s, padded[i : i + self.size], 0) for i in range(0, len(padded), self.size)]
        at, cost, after = 0, 0, []
        for code in reversed(codes):
            after.append(at)
            cost += self.grown[at][code]
            at = self.before[at][code]
        cost += self.vectors[at][_START]
        parts, state = [], _START
        for code in codes:
            letters, state = self._expand(after.pop(), code, state)
            parts.append(letters)
        parts.append("I" * (_END[state] // INSERT))
        return cost, "".join(parts)


@functools.lru_cache(maxsize=1)
def block_tables() -> BlockTables:
    return BlockTables()


def symbol_of(role: str, fault: str | None) -> int:
    """The symbol of a turn by its role and its fault (blank, duplicate, truncated or none)."""
    if fault in ("blank", "duplicate"):
        return _GONE
    return _SOUND.get(role[:1], _OTHER) + (4 if fault == "truncated" else 0)


# ---------------------------------------------------------------- turns of conversations


class _Turns:
    """The turns of the conversation at hand, in order; beyond HELD_BYTES in a file that goes with the task."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str]] = []
        self.bytes, self.file = 0, None

    def add(self, role: str, text: str) -> None:
        self.rows.append((role, text))
        self.bytes += len(text) + len(role) + 100
        if self.bytes > HELD_BYTES:
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # noqa: SIM115: closed with the conversation
            pickle.dump(self.rows, self.file)
            self.rows, self.bytes = [], 0

    def __iter__(self) -> Iterator[tuple[str, str]]:
        if self.file is not None:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
        yield from self.rows

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _applied(turns: _Turns, letters: str) -> Iterator[tuple[str, str | None, str | None]]:
    """(letter, role, text) of each edit: of the turn that results; of a deleted one no role and text."""
    rows, state = iter(turns), _START
    for letter in letters:
        if letter == "I":
            role, text = _ROLE_AFTER[state], ""
        else:
            role, text = next(rows)
            if letter == "D":
                yield "D", None, None
                continue
            if letter == "R":
                role = _ROLE_AFTER[state]
        state = _SYSTEM if role[:1] == "s" else _AFTER_ROLE[_ROLE_AFTER[state]]
        yield letter, role, text


class _Conversation:
    """What is known of a conversation while its turns come in."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.symbols = conv_id, _Turns(), bytearray()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.numbers, self.low, self.high = 0, 0, None, None
        self.last: tuple | None = None

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if self.last is not None:
            if fault != "blank" and self.last == (turn, role, text):
                fault = "duplicate"
            self.illegal += (self.last[1][:1] + role[:1]) not in ("su", "ua", "au")
        if turn is not None and turn != self.high:
            self.numbers, self.high = self.numbers + 1, turn
            self.low = turn if self.low is None else self.low
        if fault:
            self.faults[fault] += 1
        self.symbols.append(symbol_of(role, fault))
        self.turns.add(role, text)
        self.last = turn, role, text

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.numbers


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[_Conversation]:
    """The conversations of sorted turns, one after the other."""
    current = None
    for batch in batches:
        for conv_id, turn, role, text, fault in zip(*(batch.column(c).to_pylist() for c in _SORTED), strict=True):
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    yield current
                    current.turns.close()
                current = _Conversation(conv_id)
            current.add(turn, role, text, fault)
    if current is not None:
        yield current
        current.turns.close()


_SORTED = ("conv_id", "turn", "role", "text", "fault")
_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPAIRED = "conv_id long, place long, edit string, role string, text string"


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    names = [part.split()[0] for part in _REPORT.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] * 2
    for one in _conversations(batches):
        cost, letters = block_tables().cheapest(one.symbols)
        digest, first = hashlib.sha256(), True
        for _, role, text in _applied(one.turns, letters):
            if role is not None:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        rows.append((one.conv_id, one.gaps, *one.faults.values(), one.illegal, cost, letters, digest.hexdigest()))
        if len(rows) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [part.split()[0] for part in _REPAIRED.split(", ")]

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    rows, size = [], 0
    for one in _conversations(batches):
        _, letters = block_tables().cheapest(one.symbols)
        for place, (letter, role, text) in enumerate(x for x in _applied(one.turns, letters) if x[1] is not None):
            rows.append((one.conv_id, place, letter, role, text))
            size += len(text) + 50
            if size > 1 << 20:
                yield to_batch(rows)
                rows, size = [], 0
    if rows:
        yield to_batch(rows)


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault) of all turns by conversation, in order; null roles and texts are one space.

    A text met earlier under the same role is looked up by its digest: of each, only the first turn counts, folded before
    the shuffle. Equal rows of one turn stand next to each other and are left to the pass over them.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
    )
    rows = rows.withColumns({"_trimmed": F.rtrim("text", F.lit(BLANK)), "_print": F.md5(F.col("text").cast("binary"))})
    last = F.substring("_trimmed", -1, 1)
    rows = rows.withColumn("fault", F.when(F.col("_trimmed") == "", "blank").when(~last.isin(".", "!", "?"), "truncated")).drop("_trimmed")
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    met = rows.where(F.coalesce(F.col("fault") != "blank", F.lit(True))).groupBy("conv_id", "role", "_print")
    firsts = met.agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where(F.col("_first") != F.col("_last"))
    firsts = firsts.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("_print").alias("_digest"), "_first")
    same = _same(F.col("conv_id"), F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("_print") == F.col("_digest"))
    told = rows.join(firsts, same, "left")
    again = (F.col("fault").isNull() | (F.col("fault") != "blank")) & F.coalesce(place > F.col("_first"), F.lit(False))
    told = told.select("conv_id", "turn", "role", "text", F.when(again, "duplicate").otherwise(F.col("fault")).alias("fault"))
    return told.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def repair_report(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    Turns are taken by number, nulls first, equal numbers by role and text. A turn's first fault counts: blank, duplicate
    (role and text were met earlier), truncated (its last character but white space is none of `.!?`). `gaps`: numbers
    missing between the first and the last. `illegal`: neighbours whose role initials are not su, ua or au. `cost` and
    `audit`: the cheapest edits (Keep, Rerole, Delete, Insert) after which the initials read `(s?(ua)+)?`, of several the
    ASCII-least. `repaired_sha256`: of the repaired `role:text` lines.

    Null roles and texts count as one space; rows without a conv_id are one conversation. Repeated rows are duplicates.
    An empty table gives no rows; other columns are ignored. The digest and the audit of a conversation are sequential by
    what they are, so its turns pass through one task, sorted; a symbol of each is held, and its texts go to a file of the
    task beyond HELD_BYTES.
    """
    return _sorted_turns(conversations).mapInArrow(_reports, _REPORT)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text) of every turn of the repaired conversations; edit is K, R or I.

    Faults, order, nulls and repeats as in `repair_report`; a conversation whose cheapest repair is empty has no rows.
    """
    return _sorted_turns(conversations).mapInArrow(_repaired_rows, _REPAIRED)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with damage by crc32 of `conv_id:turn` modulo 20 (nulls: one space); all columns stay.

    0 drops a row, 1 empties its text, 2 removes `.`, `!` and `?`, 3 repeats the row, 4 makes its role user.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    schema = widened(conversations.drop("text", "role"))
    others = [c for c in schema.names]
    role = F.when(kind == 4, "user").otherwise(spaced("role")).alias("role")
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text")).alias("text")
    times = F.explode(F.array_repeat(F.lit(1), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))).alias("_times")
    return conversations.select(*[F.col(f"`{c}`") for c in others], role, text, times).drop("_times")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """The report of the damaged conversations, with zeros for those of which the damage leaves no row."""
    report = repair_report(damage(conversations.select("conv_id", "turn", "role", "text")))
    every = conversations.select(F.col("conv_id").cast("long").alias("_of")).distinct()
    told = every.join(report, _same(F.col("_of"), F.col("conv_id")), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    columns = [F.coalesce(F.col(c), F.lit(empty.get(c, 0))).alias(c) for c in report.columns[1:]]
    return told.select(F.col("_of").alias("conv_id"), *columns)
