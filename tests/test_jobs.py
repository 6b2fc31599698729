"""The stream and the batch jobs end to end, with exact counts."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from tests.helpers import ITEMS, record

from tidelake import fixtures as fx
from tidelake.functions.contracts import BrokenContract, Contract, ContractError, ContractFolder, Field, load_contract, load_contracts, to_text
from tidelake.operators import bronze, report
from tidelake.plans import gold_job, silver_job
from tidelake.plans.silver_job import SilverOptions
from tidelake.sources import seed
from tidelake.sources.lake import BronzeFiles, BronzeTables
from tidelake.streaming.bronze_stream import start_bronze

SCHEMA = "topic string, value string, partition int, offset bigint"


def land(folder, name, values, topic="cdc.public.items", first=0):
    """A file of records for the file source."""
    folder.mkdir(exist_ok=True)
    rows = [{"topic": topic, "value": v, "partition": 0, "offset": first + i} for i, v in enumerate(values)]
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def stream(spark, folder, files_per_batch=None):
    reader = spark.readStream.schema(SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(str(folder))


def run(spark, folder, store, checkpoint, contracts, **options):
    running = start_bronze(stream(spark, folder, **options), store, str(checkpoint), contracts, interval=None)
    running.awaitTermination()
    return running


def good(i):
    return record("c", {"id": i, "name": f"n{i}"}, ts_ms=1700000000000 + i)


@pytest.mark.parametrize("kind", ["files", "tables"])
def test_stream_restart_and_replay(spark, tmp_path, kind):
    store = BronzeFiles(str(tmp_path / "b")) if kind == "files" else BronzeTables(f"stream_{tmp_path.name}".replace("-", "_"))
    source, contracts = tmp_path / "in", {"items": ITEMS}
    land(source, "1.json", [good(1), "{broken"])
    land(source, "2.json", [good(2), good(3)], first=2)
    run(spark, source, store, tmp_path / "cp", contracts, files_per_batch=1)
    land(source, "3.json", [good(4)], first=4)
    run(spark, source, store, tmp_path / "cp", contracts, files_per_batch=1)  # continues, reads file 3 only
    counts = lambda: (store.read(spark, "items", "valid").count(), store.read(spark, "items", "invalid").count())
    assert counts() == (4, 1)
    # A new checkpoint is another stream: it reads everything again, and nothing of the first is lost.
    run(spark, source, store, tmp_path / "cp2", contracts, files_per_batch=1)
    assert counts() == (8, 2)


def test_contracts_can_change_while_the_stream_runs(spark, tmp_path):
    store, source, current = BronzeFiles(str(tmp_path / "b")), tmp_path / "in", {}
    land(source, "1.json", ["{broken"])
    run(spark, source, store, tmp_path / "cp", lambda: current)
    current["items"] = ITEMS
    land(source, "2.json", ["{broken"], first=1)
    run(spark, source, store, tmp_path / "cp", lambda: current)
    assert store.read(spark, "items", "valid").count() == 1
    assert store.read(spark, "items", "invalid").count() == 1


def test_new_topic_is_routed_to_its_own_pair(spark, tmp_path):
    store, source = BronzeFiles(str(tmp_path / "b")), tmp_path / "in"
    land(source, "1.json", [good(1)])
    land(source, "2.json", [good(1), good(2)], topic="cdc.public.fresh")
    run(spark, source, store, tmp_path / "cp", {"items": ITEMS})
    assert store.read(spark, "fresh").count() == 2 and store.read(spark, "items").count() == 1


def write_bronze(spark, store, values, batch_id, at, contracts, topic="cdc.public.items"):
    rows = [(topic, v, 0, batch_id * 1000 + i) for i, v in enumerate(values)]
    store.write(bronze.to_bronze(spark.createDataFrame(rows, SCHEMA), contracts, ingested_at=at), batch_id)


def names(spark, table):
    return {r["id"]: r["name"] for r in spark.table(table).filter("_cdc_op <> 'd'").collect()}


@pytest.mark.parametrize("buckets", [None, 4])
def test_merge_days(spark, tmp_path, buckets):
    store, contracts = BronzeFiles(str(tmp_path / "b")), {"items": ITEMS}
    database = f"days_{buckets}"
    options = SilverOptions(database=database, buckets=buckets, count=True)
    write_bronze(spark, store, [good(1), good(2), good(3)], 0, "2024-03-01 10:00:00", contracts)
    day2 = [record("u", {"id": 2, "name": "new"}, 1700000001000), record("d", {"id": 3}, 1700000001000), good(4)]
    write_bronze(spark, store, day2, 1, "2024-03-02 10:00:00", contracts)
    merge = lambda day: silver_job.merge_day(spark, store, ITEMS, day, options=options)
    assert merge("2024-02-28").status == "empty"
    assert merge("2024-03-01").rows == 3
    assert merge("2024-03-02").rows == 3
    expected = {1: "n1", 2: "new", 4: "n4"}
    assert names(spark, f"{database}.items") == expected
    merge("2024-03-02")  # a rerun changes nothing
    assert names(spark, f"{database}.items") == expected
    merge("2024-03-01")  # neither does a rerun of an old day
    assert names(spark, f"{database}.items") == expected
    assert not [f for f in os.listdir(spark.conf.get("spark.checkpoint.dir")) if f.startswith("silver-items")]  # nothing staged stays


def test_hard_delete_leaves_no_trace(spark, tmp_path):
    store, contracts = BronzeFiles(str(tmp_path / "b")), {"items": ITEMS}
    options = SilverOptions(database="hard", tombstones=False, count=True)
    write_bronze(spark, store, [good(1), good(3)], 0, "2024-03-01 10:00:00", contracts)
    write_bronze(spark, store, [record("d", {"id": 3}, 1700000001000)], 1, "2024-03-02 10:00:00", contracts)
    rows = [silver_job.merge_day(spark, store, ITEMS, d, options=options).rows for d in ("2024-03-01", "2024-03-02", "2024-03-01")]
    assert rows == [2, 1, 2] and spark.table("hard.items").filter("_cdc_op = 'd'").isEmpty()


@pytest.mark.parametrize("tombstones", [True, False])
def test_equal_times_are_ordered_by_log_position_across_runs(spark, tmp_path, tombstones):
    store, contracts = BronzeFiles(str(tmp_path / "b")), {"items": ITEMS}
    options = SilverOptions(database=f"ties_{tombstones}", tombstones=tombstones)
    write_bronze(spark, store, [record("u", {"id": 1, "name": "low"}, 5, lsn=10)], 0, "2024-03-01 10:00:00", contracts)
    write_bronze(spark, store, [record("u", {"id": 1, "name": "high"}, 5, lsn=20)], 1, "2024-03-02 10:00:00", contracts)
    for day in ("2024-03-01", "2024-03-02", "2024-03-01"):
        silver_job.merge_day(spark, store, ITEMS, day, options=options)
    assert names(spark, f"ties_{tombstones}.items") == {1: "high"}


def test_merge_with_tombstones_survives_an_old_day(spark, tmp_path):
    store, contracts = BronzeFiles(str(tmp_path / "b")), {"items": ITEMS}
    options = SilverOptions(database="graves", tombstones=True)
    write_bronze(spark, store, [good(1), good(3)], 0, "2024-03-01 10:00:00", contracts)
    write_bronze(spark, store, [record("d", {"id": 3}, 1700000001000)], 1, "2024-03-02 10:00:00", contracts)
    for day in ("2024-03-02", "2024-03-01"):
        silver_job.merge_day(spark, store, ITEMS, day, options=options)
    assert {r["id"] for r in spark.table("graves.items").filter("_cdc_op <> 'd'").collect()} == {1}


def test_reprocess_quarantine(spark, tmp_path):
    store = BronzeFiles(str(tmp_path / "b"))
    wrong = Contract("items", (Field("id", "long", True, True), Field("name", "integer")))
    write_bronze(spark, store, [good(1), "{broken", good(2)], 0, "2024-03-01 10:00:00", {"items": wrong})
    options = SilverOptions(database="again")
    assert silver_job.merge_day(spark, store, ITEMS, "2024-03-01", options=options).status == "empty"
    silver_job.merge_day(spark, store, ITEMS, "2024-03-01", reprocess_invalid=True, options=options)
    assert names(spark, "again.items") == {1: "n1", 2: "n2"}


def test_one_failing_table_does_not_stop_the_others(spark, tmp_path):
    store = BronzeFiles(str(tmp_path / "b"))
    keyless = Contract("keyless", (Field("a"),))
    contracts = {"items": ITEMS, "keyless": keyless, "quiet": Contract("quiet", (Field("id", "long", True, True),))}
    write_bronze(spark, store, [good(1)], 0, "2024-03-01 10:00:00", contracts)
    outcomes = silver_job.merge_all(spark, store, contracts, "2024-03-01", options=SilverOptions(database="several"))
    assert {o.table: o.status for o in outcomes} == {"items": "merged", "keyless": "failed", "quiet": "empty"}
    log = str(tmp_path / "log")
    for run in ("r1", "r2"):
        silver_job.merge_all(spark, store, contracts, "2024-03-01", options=SilverOptions(database="several"), log=log, run_id=run)
    assert spark.read.parquet(log).count() == 6
    summary = report.run_report(spark.read.parquet(log)).filter("run_id = 'r1'").first()
    assert summary["status"] == "ERROR" and not summary["passed"] and "no primary key" in summary["error"]


def test_whole_pipeline_on_seeded_rows(spark, tmp_path):
    """100 customers and 100 orders through stream, silver and gold."""
    series = seed.number_series(spark, 100)
    customers = seed.seed_customers(series)
    orders = seed.seed_orders(series, 100, seed=1)
    from tidelake.operators.capture import snapshot_to_cdc

    source = tmp_path / "in"
    records = snapshot_to_cdc(customers, "customers", ["customer_id"], F.lit(1700000000000)).select("topic", "value")
    records = records.unionByName(
        snapshot_to_cdc(orders, "orders", ["order_id"], F.lit(1700000000000), wrapped=False).select("topic", "value")
    )
    records.write.json(str(source))
    store, contracts = BronzeFiles(str(tmp_path / "b")), {"customers": fx.CUSTOMERS, "orders": fx.ORDERS}
    running = start_bronze(
        spark.readStream.schema("topic string, value string").json(str(source)),
        store,
        str(tmp_path / "cp"),
        contracts,
        interval=None,
    )
    running.awaitTermination()
    day = store.read(spark, "orders").select(F.to_date("_ingested_at").cast("string")).first()[0]
    options = SilverOptions(database="seeded_silver", count=True)
    assert [o.rows for o in silver_job.merge_all(spark, store, contracts, day, options=options)] == [100, 100]
    reports = gold_job.refresh_gold(spark, "seeded_silver", "seeded_gold", "decimal(18,2)")
    assert all(r["n_violations"] == 0 for frame in reports.values() for r in frame.collect())
    total = orders.agg(F.sum("amount").cast("double")).first()[0]
    summary = spark.table("seeded_gold.orders_summary")
    assert summary.count() == 5 and round(summary.agg(F.sum("total_amount")).first()[0], 2) == round(total, 2)
    per_customer = spark.table("seeded_gold.customers_orders")
    assert per_customer.count() == 100 and per_customer.filter("total_orders = 1").count() == 100


def test_gold_is_not_published_when_a_test_fails(spark):
    checks = [gold_job.Check("unique", "id")]
    gold_job.materialize(spark, "audited.model", spark.range(3), checks)
    with pytest.raises(gold_job.ChecksFailed):
        gold_job.materialize(spark, "audited.model", spark.range(3).union(spark.range(1)), checks)
    assert spark.table("audited.model").count() == 3


def test_missing_lifetime_value_is_only_reported(spark):
    meta = ", _cdc_op string, _cdc_ts timestamp, _ingested_at timestamp"
    spark.sql("CREATE DATABASE IF NOT EXISTS lonely")
    customers = [(1, "a@x", "A", "c", None, dt.datetime(2024, 3, 1))]
    spark.createDataFrame(customers, "customer_id bigint, email string, name string" + meta).write.saveAsTable("lonely.customers")
    orders = "order_id bigint, customer_id bigint, status string, amount double" + meta
    spark.createDataFrame([], orders).write.saveAsTable("lonely.orders")
    reports = gold_job.refresh_gold(spark, "lonely", "lonely_gold")
    found = {(r["check_name"], r["column_name"]): r["n_violations"] for r in reports["customers_orders"].collect()}
    assert found[("not_null", "lifetime_value")] == 1
    row = spark.table("lonely_gold.customers_orders").first()
    assert row["total_orders"] == 0 and row["lifetime_value"] is None


def test_contract_folder(spark, tmp_path):
    (tmp_path / "items.yaml").write_text(to_text(ITEMS))
    (tmp_path / "orders.yaml").write_text(
        "name: orders\nschema:\n  - name: orders\n    type: table\n    fields:\n"
        "      - {name: id, type: integer, required: true}\n      - {name: total_amount, type: number}\n"
    )
    (tmp_path / "notes.txt").write_text("not a contract")
    contracts = load_contracts(spark, str(tmp_path))
    assert contracts["items"] == ITEMS
    assert contracts["orders"].keys == [] and contracts["orders"].not_null == ["id"]
    with pytest.raises(FileNotFoundError):
        load_contract(spark, str(tmp_path), "absent")


BROKEN = {
    "unknown_rule.yaml": "name: unknown_rule\nschema: {fields: [{name: id, type: long, primaryKey: true}]}\nquality: [{type: rowCount}]",
    "misspelt.yaml": "name: misspelt\nschema: {fields: [{name: s}]}\nquality: [{type: not_null, column: s}]",
    "other.yaml": "name: other\nschema: [{name: orders, fields: [{name: id}]}]",
    "nameless.yaml": "name: nameless\nschema: {fields: [{type: long}]}",
    "empty.yaml": "name: empty",
    "text.yaml": "just text",
    "bad_yaml.yaml": "name: [",
}


def test_a_broken_contract_holds_back_its_own_table_only(spark, tmp_path):
    folder = tmp_path / "contracts"
    folder.mkdir()
    (folder / "items.yaml").write_text(to_text(ITEMS))
    for name, text in BROKEN.items():
        (folder / name).write_text(text)
    contracts = load_contracts(spark, str(folder))
    assert {t for t, c in contracts.items() if isinstance(c, BrokenContract)} == {n.removesuffix(".yaml") for n in BROKEN}
    assert load_contract(spark, str(folder), "items") == ITEMS
    with pytest.raises(ContractError):
        load_contract(spark, str(folder), "misspelt")
    store, source = BronzeFiles(str(tmp_path / "b")), tmp_path / "in"
    land(source, "1.json", [good(1)])
    land(source, "2.json", [good(1), None], topic="cdc.public.misspelt")
    run(spark, source, store, tmp_path / "cp", ContractFolder(spark, str(folder)))
    assert store.read(spark, "items").count() == 1
    held = store.read(spark, "misspelt", "invalid").collect()
    assert len(held) == 1 and "not_null" in held[0]["_validation_error"]
    day = store.read(spark, "items").select(F.to_date("_ingested_at").cast("string")).first()[0]
    outcomes = silver_job.merge_all(spark, store, contracts, day, options=SilverOptions(database="isolated"))
    assert {o.table: o.status for o in outcomes} == {"items": "merged", **{t: "failed" for t in contracts if t != "items"}}


def test_contracts_are_read_again_when_the_folder_changes(spark, tmp_path):
    (tmp_path / "items.yaml").write_text(to_text(ITEMS))
    folder = ContractFolder(spark, str(tmp_path))
    first = folder()
    assert folder() is first
    (tmp_path / "more.yaml").write_text(to_text(Contract("more", (Field("id", "long", True, True),))))
    assert set(folder()) == {"items", "more"}


def test_gold_waits_for_sound_silver_tables(spark):
    meta = ", _cdc_op string, _cdc_ts timestamp, _ingested_at timestamp"
    at = dt.datetime(2024, 3, 1)
    spark.sql("CREATE DATABASE IF NOT EXISTS unsound")
    customers = [(1, "a@x", "A", "c", at, at), (1, "b@x", "B", "c", at, at)]
    spark.createDataFrame(customers, "customer_id bigint, email string, name string" + meta).write.saveAsTable("unsound.customers")
    orders = [(1, 1, "pending", 1.0, "c", at, at), (1, None, None, None, "d", at, at)]  # a deleted key is no duplicate
    spark.createDataFrame(orders, "order_id bigint, customer_id bigint, status string, amount double" + meta).write.saveAsTable("unsound.orders")
    with pytest.raises(gold_job.ChecksFailed, match="unsound.customers"):
        gold_job.refresh_gold(spark, "unsound", "unsound_gold")
    assert not spark.catalog.databaseExists("unsound_gold")
    found = gold_job.silver_violations(spark, "unsound")
    assert found["orders"] == [] and [(r["check_name"], r["column_name"]) for r in found["customers"]] == [("unique", "customer_id")]
