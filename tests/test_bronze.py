"""Envelope variants, contract rules, routing."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from tests.helpers import ITEMS, changes, record

from tidelake.functions.contracts import Contract, Field, Rule
from tidelake.operators import bronze

CONTRACTS = {"items": ITEMS}
AT = "2024-03-01 10:00:00"
ROW = {"id": 1, "name": "a", "price": 1.5, "ok": True}


def verdicts(spark, values, contracts=CONTRACTS, policy="pass"):
    rows = bronze.to_bronze(changes(spark, values), contracts, policy, AT).orderBy("_offset").collect()
    return [r["_validation_error"] for r in rows]


def test_wrapped_and_bare_envelopes_are_the_same(spark):
    rows = bronze.to_bronze(
        changes(spark, [record("U", ROW, 1700000000123), record("u", ROW, 1700000000123, wrapped=False)]),
        CONTRACTS,
        ingested_at=AT,
    ).collect()
    assert {(r["_cdc_op"], r["_validation_error"]) for r in rows} == {("u", "")}
    assert {r["_cdc_ts"] for r in rows} == {dt.datetime(2023, 11, 14, 22, 13, 20, 123000)}


def test_op_defaults_to_snapshot_read(spark):
    rows = bronze.to_bronze(changes(spark, ['{"after": {"id": 1, "name": "a"}}']), CONTRACTS).collect()
    assert rows[0]["_cdc_op"] == "r"


@pytest.mark.parametrize("ts", ["null", '"soon"', "99999999999999999", '"1e400"'])
def test_unusable_event_time_falls_back_to_ingestion(spark, ts):
    value = '{"op":"c","after":{"id":1,"name":"a"},"ts_ms":%s}' % ts
    row = bronze.to_bronze(changes(spark, [value]), CONTRACTS, ingested_at=AT).first()
    assert row["_cdc_ts"] == row["_ingested_at"] == dt.datetime(2024, 3, 1, 10)


def test_event_time_as_text(spark):
    row = bronze.to_bronze(changes(spark, [record("c", ROW, "1700000000000")]), CONTRACTS, ingested_at=AT).first()
    assert row["_cdc_ts"] == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_defects(spark):
    good = '{"op":"c","after":{"id":1,"name":"a"}}'
    values = [
        '{"payload": {"op": "c"',
        "[]",
        "12",
        '"text"',
        "null",
        "]",
        good + " trailing",
        good + good,
        good + "," + good,
        good + "}",
        good + "]",
        good + "] {}",
    ]
    objects = ["malformed json"] + ["not an object"] * 4 + ["malformed json"] * 7
    assert verdicts(spark, values) == objects


def test_a_misshapen_envelope_has_no_row(spark):
    assert verdicts(spark, ['{"op":"c","after":5}', '{"payload":"x"}', "{}"]) == ["id: required; name: required"] * 3


def test_tombstones_are_kept_as_valid_reads(spark):
    rows = bronze.to_bronze(changes(spark, [None, "", "  "]), CONTRACTS, "fail", AT).collect()
    assert [(r["_cdc_op"], r["_validation_error"]) for r in rows] == [("r", "")] * 3


def test_defects_pass_without_a_contract(spark):
    assert verdicts(spark, ["{broken", "[]", record("c", ROW)], {}) == ["", "", ""]


def test_missing_contract_can_fail(spark):
    assert verdicts(spark, [record("c", ROW), "{broken"], {}, "fail") == ["contract not found: items"] * 2
    with pytest.raises(ValueError):
        verdicts(spark, [], {}, "maybe")


def test_rules(spark):
    values = [
        record("c", ROW),
        record("c", {"id": "5", "name": "a", "price": "12.30", "ok": "false"}),  # quoted values are fine
        record("c", {"id": 7.5, "name": None, "price": "x", "ok": "maybe"}),
        record("c", {"name": "a"}),
        record("c", None),
        record("d", {"id": 1}),  # a delete needs its key only
        record("d", {"name": "a"}),
        record("d", None),
    ]
    assert verdicts(spark, values) == [
        "",
        "",
        "id: type; name: required; price: type; ok: type",
        "id: required",
        "id: required; name: required",
        "",
        "id: required",
        "id: required",
    ]


def test_not_null_rule_on_an_optional_or_unlisted_column(spark):
    contract = Contract(
        "items", (Field("id", "long", True, True), Field("name")), (Rule("notNull", "name"), Rule("notNull", "extra"))
    )
    values = [record("c", {"id": 1, "name": "a", "extra": 0}), record("c", {"id": 1})]
    assert verdicts(spark, values, {"items": contract}) == ["", "name: required; extra: required"]


def test_each_record_meets_the_contract_of_its_own_table(spark):
    other = Contract("other", (Field("code", "integer", True, True),))
    frame = changes(spark, [record("c", ROW)]).unionByName(
        changes(spark, [record("c", {"code": "x"}), record("c", {"code": 3})], "cdc.public.other")
    )
    rows = bronze.to_bronze(frame, {"items": ITEMS, "other": other}, ingested_at=AT)
    counts = {(r["_table"], r["_status"]): r["n_rows"] for r in bronze.routing_counts(rows).collect()}
    assert counts == {("items", "valid"): 1, ("other", "valid"): 1, ("other", "invalid"): 1}


def test_valid_and_invalid_split_the_input(spark):
    values = [record("c", ROW), "{broken", None, record("c", {"id": None}), record("d", {"id": 3})]
    rows = bronze.to_bronze(changes(spark, values), CONTRACTS, ingested_at=AT)
    valid, invalid = bronze.valid_rows(rows, "items"), bronze.invalid_rows(rows, "items")
    offsets = sorted(r["_offset"] for r in valid.collect() + invalid.collect())
    assert offsets == [0, 1, 2, 3, 4]
    assert valid.columns == list(bronze.VALID_COLUMNS)
    assert invalid.columns == list(bronze.INVALID_COLUMNS)


def test_binary_kafka_columns(spark):
    frame = changes(spark, [record("c", ROW)]).select(
        F.col("topic").cast("binary"), F.col("value").cast("binary"), "partition", "offset"
    )
    row = bronze.to_bronze(frame, CONTRACTS, ingested_at=AT).first()
    assert row["_table"] == "items" and json.loads(row["_raw_value"])["payload"]["after"] == ROW


def test_source_without_offsets(spark):
    frame = changes(spark, [record("c", ROW)]).select("topic", "value")
    assert bronze.to_bronze(frame, CONTRACTS, ingested_at=AT).first()["_offset"] is None


def test_day_slice_is_half_open(spark):
    frame = spark.createDataFrame(
        [("2024-02-29 23:59:59.999999",), ("2024-03-01 00:00:00",), ("2024-03-01 23:59:59.999999",), ("2024-03-02 00:00:00",)],
        "t string",
    ).select(F.col("t").cast("timestamp").alias("_ingested_at"))
    assert bronze.day_slice(frame, "2024-03-01").count() == 2
    assert bronze.day_slice(frame, dt.date(2024, 2, 29)).count() == 1


def test_revalidate_uses_the_contract_of_today(spark):
    strict = Contract("items", (Field("id", "long", True, True), Field("name", "integer")))
    judged = bronze.to_bronze(changes(spark, [record("U", ROW), "{broken"]), {"items": strict}, ingested_at=AT)
    quarantine = bronze.invalid_rows(judged, "items")
    assert quarantine.count() == 2
    again = bronze.revalidate(quarantine, CONTRACTS)
    passed = bronze.valid_rows(again).collect()
    assert [(r["_cdc_op"], r["_offset"], r["_ingested_at"]) for r in passed] == [("u", 0, dt.datetime(2024, 3, 1, 10))]


def test_a_record_is_parsed_once_under_filters(spark):
    rows = bronze.to_bronze(changes(spark, [record("c", ROW)]), CONTRACTS, ingested_at=AT)
    plan = bronze.valid_rows(rows, "items")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(ArrayType(") == 1
