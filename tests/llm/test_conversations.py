import hashlib
import itertools
import random
import re
import zlib

import pytest
from tests.llm.helpers import CLASHING
from tests.test_queries import DATA

from tidelake.llm import conversations, queries
from tidelake.llm._common import table

SCHEMA = "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
SOUND = re.compile(r"(s?(ua)+)?")


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], SCHEMA)


def brute_force(rows):
    """The cheapest edits by trying every string of them from the end, whole strings compared."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        left = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None)
        seen.add((role, text))
    best = {}

    def solve(i, state, inserts=0):
        if (i, state, inserts) not in best:
            found = []
            if i == len(rows) and state in ("", "a"):
                found.append((0, "", ()))
            add = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            name = {"u": "user", "a": "assistant"}[add]
            if inserts < 4:
                cost, letters, lines = solve(i, add, inserts + 1)
                found.append((cost + 5, "I" + letters, (f"{name}:", *lines)))
            if i < len(rows):
                _, role, text = rows[i]
                cost, letters, lines = solve(i + 1, state)
                found.append((cost + 2, "D" + letters, lines))
                if faults[i] not in ("blank", "duplicate"):
                    extra = 5 if faults[i] == "truncated" else 0
                    if role[:1] == add or (role[:1] == "s" and state == ""):
                        cost, letters, lines = solve(i + 1, role[0])
                        found.append((cost + extra, "K" + letters, (f"{role}:{text}", *lines)))
                    cost, letters, lines = solve(i + 1, add)
                    found.append((cost + 1 + extra, "R" + letters, (f"{name}:{text}", *lines)))
            best[i, state, inserts] = min(found, default=(1 << 30, "~", ()))
        return best[i, state, inserts]

    cost, letters, lines = solve(0, "")
    turns = {r[0] for r in rows if r[0] is not None}
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)),
        "cost": cost,
        "audit": letters,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def damaged(conv_id, rows):
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{name(conv_id)}:{name(turn)}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def check(found, wanted):
    got = {r.conv_id: {c: r[c] for c in r.__fields__ if c != "conv_id"} for r in found}
    assert len(found) == len(got) and got.keys() == wanted.keys()
    for conv_id, row in wanted.items():
        assert got[conv_id] == row, conv_id


def by_conversation(rows):
    of = {}
    for conv_id, turn, role, text in rows:
        of.setdefault(conv_id, []).append((turn, role, text))
    return of


def test_all_conversations(spark):
    rows = [tuple(r) for r in table(spark, DATA, "conversations").select("conv_id", "turn", "role", "text").collect()]
    wanted = {c: brute_force(damaged(c, own)) for c, own in by_conversation(rows).items()}
    check(queries.op13_conversation_repair(spark, DATA).collect(), wanted)


def test_random_conversations(spark):
    rng = random.Random(13)
    rows = []
    for conv_id in range(400):
        for _ in range(rng.randrange(1, 12)):
            turn = rng.choice([None, *range(9)])
            rows.append((conv_id, turn, rng.choice(["user", "assistant", "system", "tool", "", "User"]), rng.choice(["", " \n", "Yes.", "No!", "Oh?\t", "cut", "cut \r", "a é", "é."])))
    wanted = {c: brute_force(own) for c, own in by_conversation(rows).items()}
    check(conversations.repair_report(frame(spark, rows)).collect(), wanted)
    turns = conversations.repaired_turns(frame(spark, rows)).collect()
    for conv_id, row in wanted.items():
        own = sorted((t for t in turns if t.conv_id == conv_id), key=lambda t: t.place)
        assert SOUND.fullmatch("".join(t.role[0] for t in own)) and "".join(t.edit for t in own) == row["audit"].replace("D", "")
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in own).encode()).hexdigest() == row["repaired_sha256"]


def test_edges(spark):
    rows = [(None, 1, "user", "No id."), (None, 2, "assistant", "None."), (1, None, None, None), (2, 0, "user", "x" * 300_000 + "."), (2, 1, "assistant", "Yes."), (2, 1, "assistant", "Yes."), (2, 5, "assistant", "Yes.")]
    rows += [(c, 0, "user", "Alone.") for c in range(10, 60)]
    wanted = {c: brute_force(damaged(c, own)) for c, own in by_conversation(rows).items()}
    found = conversations.damaged_and_repaired(frame(spark, rows)).collect()
    check(found, wanted)
    gone = [c for c, own in by_conversation(rows).items() if not damaged(c, own)]
    assert gone and all(r.audit == "" and r.cost == r.gaps == 0 for r in found if r.conv_id in gone)
    assert conversations.damaged_and_repaired(frame(spark, [])).count() == 0
    assert conversations.repaired_turns(frame(spark, [])).count() == 0


def test_turns_beyond_the_bound_go_to_a_file(spark, monkeypatch):
    turns = conversations._Turns()
    monkeypatch.setattr(conversations, "HELD_BYTES", 1000)
    rows = [("user", f"text {i}") for i in range(100)]
    for row in rows:
        turns.add(*row)
    assert turns.file is not None and list(turns) == rows
    turns.close()


def test_long_conversations_cost_what_single_steps_cost():
    rng = random.Random(14)
    tables = conversations.block_tables()
    for n in (1, 2, 3, 4, 50, 1001):
        symbols = bytes(rng.randrange(1, 10) for _ in range(n))
        costs = conversations._END
        for s in reversed(symbols):
            costs = conversations._step(s, costs)
        cost, letters = tables.cheapest(symbols)
        assert cost == costs[0] and len(letters) - letters.count("I") == n
    assert len(tables.vectors) < 200


@pytest.mark.parametrize("size", [1, 2, 4])
def test_the_size_of_blocks_does_not_matter(size):
    rng = random.Random(15)
    other = conversations.BlockTables(size)
    for _ in range(200):
        symbols = bytes(rng.randrange(1, 10) for _ in range(rng.randrange(20)))
        assert other.cheapest(symbols) == conversations.block_tables().cheapest(symbols)
