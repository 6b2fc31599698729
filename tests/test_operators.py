"""Capture, seeds, checks, profiles, reports, contracts."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelake.functions import contracts as ct
from tidelake.functions.contracts import Contract, ContractError, Field, Rule
from tidelake.functions.types import contract_type, spark_type
from tidelake.operators import bronze, capture, checks, consume, gold, profile, report, silver
from tidelake.sources import kafka, seed

ROWS = "id bigint, name string, price double, ok boolean"


def snapshot(spark, rows):
    return spark.createDataFrame([(k, n, p, True) for k, n, p in rows], ROWS)


def pieces(frame):
    return {r["id"]: (r["op"], json.loads(r["value"])) for r in frame.collect()}


def test_snapshot_records(spark):
    got = pieces(capture.snapshot_to_cdc(snapshot(spark, [(1, None, 2.5)]), "items", ["id"], F.lit(5)))
    op, value = got[1]
    assert op == "r" and value["payload"]["before"] is None
    assert value["payload"]["after"] == {"id": 1, "name": None, "price": 2.5, "ok": True}
    assert value["payload"]["ts_ms"] == 5 and value["payload"]["source"]["table"] == "items"


def test_diff_records_and_replica_identity(spark):
    old = snapshot(spark, [(1, "a", 1.0), (2, None, 1.0), (3, "c", 1.0), (4, "same", 1.0)])
    new = snapshot(spark, [(1, "b", 1.0), (2, None, 1.0), (4, "same", 1.0), (5, "e", 1.0)])
    got = pieces(capture.diff_to_cdc(old, new, "items", ["id"], F.lit(5), wrapped=False))
    assert {k: op for k, (op, _) in got.items()} == {1: "u", 3: "d", 5: "c"}
    assert got[1][1]["before"] is None and got[1][1]["after"]["name"] == "b"
    assert got[3][1]["before"]["name"] == "c" and got[3][1]["after"] is None
    full = pieces(capture.diff_to_cdc(old, new, "items", ["id"], F.lit(5), "full", wrapped=False))
    assert full[1][1]["before"]["name"] == "a"
    with pytest.raises(ValueError):
        capture.diff_to_cdc(old, new, "items", ["id"], F.lit(5), "nothing")


TABLE = st.dictionaries(st.integers(1, 5), st.sampled_from(["a", "b", None]), max_size=5)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(old=TABLE, new=TABLE, identity=st.sampled_from(["default", "full"]), wrapped=st.booleans())
def test_diff_merged_into_the_old_snapshot_gives_the_new_one(spark, old, new, identity, wrapped):
    contract = Contract("items", (Field("id", "long", True, True), Field("name"), Field("price", "double"), Field("ok", "boolean")))
    frames = [snapshot(spark, [(k, n, 1.0) for k, n in rows.items()]) for rows in (old, new)]

    def apply(records, stored):
        rows = bronze.to_bronze(records.select("topic", "value"), {"items": contract}, ingested_at="2024-01-01")
        batch = silver.dedup_changes(silver.parse_envelope(bronze.valid_rows(rows), contract), contract)
        stored = spark.createDataFrame([], batch.schema) if stored is None else stored
        return silver.merge_frames(stored, batch, ["id"])

    first = apply(capture.snapshot_to_cdc(frames[0], "items", ["id"], F.lit(1), wrapped), None)
    records = capture.diff_to_cdc(frames[0], frames[1], "items", ["id"], F.lit(2), identity, wrapped)
    assert {r["id"]: r["name"] for r in apply(records, first).collect()} == new


def test_seeds(spark):
    series = seed.number_series(spark, 10)
    assert seed.seed_customers(series).filter("customer_id = 3").first()[1:] == ("customer_3@example.com", "Customer 3")
    orders = seed.seed_orders(series, 4, seed=7).orderBy("order_id").collect()
    assert [r["customer_id"] for r in orders][:5] == [2, 3, 4, 1, 2]
    assert [r["status"] for r in orders][:5] == ["processing", "shipped", "delivered", "cancelled", "pending"]
    assert all(0 <= r["amount"] <= 1000 for r in orders)
    assert [str(r["value"]) for r in seed.seed_items(series).orderBy("value").collect()][:2] == ["1.50", "3.00"]


def test_insert_if_absent(spark):
    schema = "email string, name string"
    existing = spark.createDataFrame([("a", "A"), (None, "N")], schema)
    incoming = spark.createDataFrame([("a", "x"), ("b", "2"), ("b", "1"), (None, "n1"), (None, "n2")], schema)
    rows = seed.insert_if_absent(existing, incoming, ["email"]).collect()
    assert sorted((r["email"] or "", r["name"]) for r in rows) == [("", "n1"), ("", "n2"), ("b", "1")]


def test_checks(spark):
    frame = spark.createDataFrame([(1, "x"), (1, None), (2, "odd"), (None, "x"), (None, "x")], "k int, s string")
    assert checks.not_null(frame, "s").count() == 1
    assert [tuple(r) for r in checks.unique(frame, "k").collect()] == [(1, 2)]
    assert checks.accepted_values(frame, "s", ["x"]).count() == 1
    declared = [checks.Check("not_null", "s"), checks.Check("unique", "k"), checks.Check("accepted_values", "s", ("x",))]
    assert [r["n_violations"] for r in checks.run_checks(frame, declared).collect()] == [1, 1, 1]
    with pytest.raises(ValueError):
        checks.run_checks(frame, [checks.Check("odd", "k")])
    contract = Contract("t", (Field("k"), Field("s")), (Rule("unique", "k"), Rule("unique", "s")))
    found = {(r["column_name"], r["value"], r["n_rows"]) for r in checks.unique_violations(frame, contract).collect()}
    assert found == {("k", "1", 2), ("s", "x", 3)}
    assert checks.unique_violations(frame, Contract("t", (Field("k"),))).isEmpty()


def test_row_count_gate_fails_on_an_empty_table(spark):
    empty = spark.range(0)
    assert tuple(checks.row_count_gate(empty, "gold").first()) == ("gold", 0, False)
    assert checks.row_count_gate(spark.range(3), "gold", 3).first()["passed"]
    ops = spark.createDataFrame([("d",)], "_cdc_op string")
    assert not checks.ops_present(ops).first()["present"]
    assert not checks.ops_present(ops.limit(0)).first()["present"]


def test_profile_keys(spark):
    frame = spark.createDataFrame(
        [(1, 1, "a", None), (1, 2, "b", 1.0), (2, 1, "c", 2.0)], "order_id int, line_id int, code string, amount double"
    )
    rows = {r["name"]: r for r in profile.profile_columns(frame).collect()}
    assert [n for n, r in rows.items() if r["is_primary_key"]] == ["code"]
    assert rows["amount"]["is_nullable"] and not rows["code"]["is_nullable"]
    assert [r["ordinal_position"] for r in rows.values()] == [1, 2, 3, 4]
    composite = profile.profile_columns(frame, ["order_id", "line_id"]).filter("is_primary_key").collect()
    assert [r["name"] for r in composite] == ["order_id", "line_id"]
    assert profile.profile_columns(frame, ["order_id"]).filter("is_primary_key").isEmpty()
    assert profile.profile_columns(frame.select("amount")).filter("is_primary_key").isEmpty()


def test_proposed_contract_round_trip(spark):
    frame = spark.createDataFrame([(1, "a", None)], "id bigint, name string, note string")
    contract = profile.propose_contract("items", profile.profile_columns(frame, ["id"]))
    assert contract.fields == (Field("id", "long", True, True), Field("name", "string", True), Field("note"))
    assert contract.rules == (Rule("notNull", "id"), Rule("notNull", "name"), Rule("unique", "id"))
    assert ct.parse_text(ct.to_text(contract), "items") == contract
    assert ct.parse_text(json.dumps(ct.to_document(contract))) == contract
    rules = [tuple(r) for r in profile.contract_rules(profile.profile_columns(frame, ["id"])).collect()]
    assert rules[0] == ("field", 1, "id", "long", True, True) and rules[-1] == ("quality", 3, "id", "unique", None, None)


def test_contract_errors_and_dialects():
    listed = ct.from_document({"name": "o", "schema": [{"name": "o", "fields": [{"name": "id", "type": "integer"}]}]})
    assert listed.fields == (Field("id", "integer"),)
    with pytest.raises(ContractError, match="no primary key"):
        listed.require_keys()
    for bad in ({"name": "o"}, {"name": "o", "schema": []}, {"name": "o; x", "schema": {"fields": [{"name": "a"}]}}, []):
        with pytest.raises(ContractError):
            ct.from_document(bad)
    with pytest.raises(ContractError):
        ct.parse_text("schema: [", "broken")


def test_types():
    assert contract_type("timestamp without time zone") == contract_type("timestamp_ntz") == "timestamp"
    assert contract_type("decimal(10,2)") == contract_type("numeric") == "number"
    assert contract_type("struct<a:int>") == "object" and contract_type("geometry") == "string"
    assert spark_type("timestamp").simpleString() == "bigint" and spark_type("object").simpleString() == "string"


def test_gold_models(spark):
    schema = "order_id int, customer_id int, status string, amount double, _cdc_op string, _ingested_at timestamp_ntz"
    import datetime as dt

    day, later = dt.datetime(2024, 1, 1, 9), dt.datetime(2024, 1, 2, 23, 59)
    orders = spark.createDataFrame(
        [(1, 1, "shipped", 0.1, "c", day), (2, 1, "shipped", 0.2, "u", later), (3, 2, "pending", 5.0, "d", day), (4, 1, "shipped", 1.0, "r", day)],
        schema,
    )
    customers = spark.createDataFrame(
        [(1, "a", "c"), (2, "b", "r"), (3, "gone", "d")], "customer_id int, email string, _cdc_op string"
    )
    rows = {(str(r["order_date"])[:10], r["status"]): (r["order_count"], r["total_amount"]) for r in gold.orders_summary(orders).collect()}
    assert rows == {("2024-01-01", "shipped"): (2, 1.1), ("2024-01-02", "shipped"): (1, 0.2)}
    got = {r["customer_id"]: tuple(r)[1:] for r in gold.customers_orders(customers, orders, "decimal(18,2)").collect()}
    assert got == {1: ("a", 3, 1.3, later), 2: ("b", 0, None, None)}
    best = consume.top_customers(gold.customers_orders(customers, orders)).collect()
    assert [r["email"] for r in best] == ["a", "b"]


def test_run_report(spark):
    log = spark.createDataFrame(
        [
            ("ok", "t", 0, "bronze", 1.5, 1.0, None),
            ("ok", "t", 1, "silver", 2.0, 42.0, None),
            ("bad", "t", 0, "bronze", 1.0, 1.0, None),
            ("bad", "t", 1, "silver", 4.0, 0.0, "out of memory"),
        ],
        report.RUN_LOG_SCHEMA,
    )
    rows = {r["run_id"]: r for r in report.run_report(log).collect()}
    assert (rows["ok"]["status"], rows["ok"]["total_seconds"], rows["ok"]["passed"]) == ("SUCCESS", 3.5, True)
    assert (rows["bad"]["status"], rows["bad"]["last_stage"], rows["bad"]["error"]) == ("ERROR", "silver", "out of memory")
    assert report.stage_seconds(log).count() == 4


def test_lag(spark):
    changes = spark.createDataFrame([("t", 0, o) for o in range(5)] + [("t", 1, 7)], "topic string, partition int, offset bigint")
    committed = spark.createDataFrame([("t", 0, 2)], "topic string, partition int, committed_offset bigint")
    rows = report.stream_lag(report.topic_offsets(changes), committed).orderBy("partition").collect()
    assert [(r["committed_offset"], r["end_offset"], r["lag"]) for r in rows] == [(2, 5, 3), (7, 8, 1)]
    progress = {"sources": [{"endOffset": '{"t":{"0":3}}', "latestOffset": '{"t":{"0":5,"1":8}}'}]}
    got = report.progress_lag(spark, progress).orderBy("partition").collect()
    assert [r["lag"] for r in got] == [2, 8]


def test_kafka_options():
    options = kafka.stream_options("host:9092", min_partitions=64)
    assert options["subscribePattern"] == r"cdc\.public\..*" and options["minPartitions"] == "64"
    assert options["startingOffsets"] == "earliest" and options["failOnDataLoss"] == "false"
    bounded = kafka.bounded_options("host:9092", "t", 0, 100)
    assert json.loads(bounded["startingOffsets"]) == {"t": {"0": 100}}
    assert json.loads(bounded["endingOffsets"]) == {"t": {"0": -1}}


def test_bounded_slice(spark):
    frame = spark.createDataFrame([("t", o % 2, o) for o in range(20)], "topic string, partition int, offset bigint")
    rows = kafka.bounded_slice(frame, "t", 0, 5, 3).collect()
    assert [r["offset"] for r in rows] == [6, 8, 10]
    assert kafka.has_records(frame, "t") and not kafka.has_records(frame, "u")
