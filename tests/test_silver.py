"""Parsing, dedup and merge: fixed cases, then properties on random histories."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.helpers import ITEMS, changes, record

from tidelake.functions.contracts import Contract, ContractError, Field
from tidelake.operators import bronze, silver

AT = "2024-03-01 10:00:00"
SCHEMA = "id bigint, name string, _cdc_op string, _cdc_ts timestamp, _ingested_at timestamp"


def valid(spark, values, contract=ITEMS):
    rows = bronze.to_bronze(changes(spark, values), {contract.table: contract}, ingested_at=AT)
    return bronze.valid_rows(rows, contract.table)


def test_parse_casts_each_field_on_its_own(spark):
    contract = Contract(
        "items",
        (
            Field("id", "long", False, True),
            Field("n", "integer"),
            Field("f", "float"),
            Field("b", "boolean"),
            Field("t", "timestamp"),
            Field("day", "date"),
            Field("doc", "object"),
        ),
    )
    row = {"id": "9", "n": "x", "f": 1.5, "b": "true", "t": 1700000000000000, "day": 19000, "doc": {"a": [1, 2]}}
    frame = changes(spark, [record("c", row)]).select(F.col("value").alias("_raw_value")).select(
        "_raw_value", F.lit("c").alias("_cdc_op"), F.lit(AT).cast("timestamp").alias("_cdc_ts"), F.lit(AT).cast("timestamp").alias("_ingested_at")
    )
    got = silver.parse_envelope(frame, contract).first()
    assert (got["id"], got["n"], got["f"], got["b"], got["t"], got["day"]) == (9, None, 1.5, True, 1700000000000000, "19000")
    assert got["doc"].replace(" ", "") == '{"a":[1,2]}'
    as_time = silver.parse_envelope(frame, contract, timestamps="timestamp").first()
    assert as_time["t"] == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_deletes_carry_the_old_row_and_tombstones_drop_out(spark):
    values = [record("c", {"id": 1, "name": "a"}), record("d", {"id": 2, "name": "b"}), None]
    rows = silver.parse_envelope(valid(spark, values), ITEMS).orderBy("id").collect()
    assert [(r["id"], r["name"], r["_cdc_op"]) for r in rows] == [(1, "a", "c"), (2, "b", "d")]


def test_contract_without_key_is_refused(spark):
    with pytest.raises(ContractError):
        silver.parse_envelope(valid(spark, []), Contract("items", (Field("a"),)))


def test_ties_are_broken_by_log_position_then_offset(spark):
    values = [
        record("c", {"id": 1, "name": "late"}, 5, lsn=20),
        record("u", {"id": 1, "name": "early"}, 5, lsn=10),
        record("c", {"id": 2, "name": "first"}, 5),
        record("u", {"id": 2, "name": "second"}, 5),
    ]
    rows = silver.dedup_changes(silver.parse_envelope(valid(spark, values), ITEMS), ITEMS)
    assert {r["id"]: r["name"] for r in rows.collect()} == {1: "late", 2: "second"}


def test_hot_key_is_reduced_before_the_shuffle(spark):
    rows = silver.dedup_changes(silver.parse_envelope(valid(spark, [record("c", {"id": 1, "name": "a"})]), ITEMS), ITEMS)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # one below the exchange, one above
    assert "Partial" in plan


def frame(spark, rows):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, n, op, base + dt.timedelta(seconds=t), base) for k, n, op, t in rows], SCHEMA)


def as_set(df):
    base = dt.datetime(2024, 1, 1)
    return {(r["id"], r["name"], r["_cdc_op"], int((r["_cdc_ts"] - base).total_seconds())) for r in df.collect()}


MERGES = [silver.merge_frames, silver.merge_small_batch]


@pytest.mark.parametrize("merge", MERGES)
def test_merge_cases(spark, merge):
    stored = frame(spark, [(1, "a", "c", 5), (2, "b", "c", 5), (3, "c", "c", 5), (4, "d", "c", 9)])
    batch = frame(spark, [(2, "B", "u", 6), (3, "c", "d", 6), (4, "x", "u", 8), (5, "e", "c", 6), (6, "f", "d", 6)])
    assert as_set(merge(stored, batch, ["id"])) == {(1, "a", "c", 5), (2, "B", "u", 6), (4, "d", "c", 9), (5, "e", "c", 6)}
    # without the guard the older change wins, as in a plain MERGE
    assert (4, "x", "u", 8) in as_set(merge(stored, batch, ["id"], guard=False))
    kept = as_set(merge(stored, batch, ["id"], tombstones=True))
    assert {(3, "c", "d", 6), (6, "f", "d", 6)} <= kept


@pytest.mark.parametrize("merge", MERGES)
def test_merge_on_a_composite_key(spark, merge):
    stored = frame(spark, [(1, "a", "c", 5), (1, "b", "c", 5)])
    batch = frame(spark, [(1, "b", "d", 6), (1, "z", "c", 6)])
    assert as_set(merge(stored, batch, ["id", "name"])) == {(1, "a", "c", 5), (1, "z", "c", 6)}


HISTORY = st.lists(st.tuples(st.integers(1, 4), st.sampled_from(["c", "u", "d"])), min_size=1, max_size=12)


def replay(history):
    """What is left after the changes are applied one by one."""
    state = {}
    for t, (key, op) in enumerate(history):
        if op == "d":
            state.pop(key, None)
        else:
            state[key] = (key, f"v{t}", op, t)
    return set(state.values())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(history=HISTORY, cuts=st.lists(st.integers(0, 2), min_size=12, max_size=12), order=st.permutations([0, 1, 2]))
def test_batches_in_any_order_give_the_same_silver(spark, history, cuts, order):
    rows = [(k, f"v{t}", op, t) for t, (k, op) in enumerate(history)]
    stored = frame(spark, [])
    for part in order:
        batch = frame(spark, [r for i, r in enumerate(rows) if cuts[i] == part])
        batch = silver.latest_per_key(batch, ["id"])
        stored = silver.merge_frames(stored, batch, ["id"], tombstones=True)
    assert as_set(silver.live_rows(stored)) == replay(history)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(history=HISTORY)
def test_both_merges_agree_and_are_idempotent(spark, history):
    rows = [(k, f"v{t}", op, t) for t, (k, op) in enumerate(history)]
    half = len(rows) // 2
    first = silver.latest_per_key(frame(spark, rows[:half]), ["id"])
    second = silver.latest_per_key(frame(spark, rows[half:]), ["id"])
    results = []
    for merge in MERGES:
        stored = merge(frame(spark, []), first, ["id"])
        once = merge(stored, second, ["id"])
        results += [as_set(once), as_set(merge(once, second, ["id"]))]
    assert all(r == replay(history) for r in results)
