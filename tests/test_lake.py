"""Storage: bronze files and tables, versioned tables."""

import pytest
from pyspark.sql import functions as F
from tests.helpers import ITEMS, changes, record

from tidelake.functions.contracts import Contract, ContractError, Field
from tidelake.operators import bronze
from tidelake.sources import lake

AT = "2024-03-01 10:00:00"
LENIENT = {}
STRICT = {"items": ITEMS}


def batch(spark, values, contracts=STRICT, at=AT, topic="cdc.public.items"):
    return bronze.to_bronze(changes(spark, values, topic), contracts, ingested_at=at)


def good(i):
    return record("c", {"id": i, "name": f"n{i}"})


@pytest.fixture(params=["files", "tables"])
def store(request, tmp_path):
    if request.param == "files":
        return lake.BronzeFiles(str(tmp_path / "bronze"))
    return lake.BronzeTables(f"bronze_{tmp_path.name}".replace("-", "_"))


def offsets(store, spark, status="valid", day=None, table="items"):
    return sorted(r["_offset"] for r in store.read(spark, table, status, day).collect())


def test_pair_reads_as_empty_before_the_first_record(spark, store):
    assert store.read(spark, "items", "valid").columns == list(bronze.VALID_COLUMNS)
    assert offsets(store, spark) == [] and offsets(store, spark, "invalid") == []


def test_empty_batch_is_a_no_op(spark, store):
    store.write(batch(spark, []), 0)
    assert offsets(store, spark) == []


def test_batches_append_and_split(spark, store):
    store.write(batch(spark, [good(1), "{broken", good(2)]), 0)
    store.write(batch(spark, [good(3)], at="2024-03-02 00:00:00"), 1)
    assert offsets(store, spark) == [0, 0, 2]
    assert offsets(store, spark, "invalid") == [1]
    assert offsets(store, spark, day="2024-03-01") == [0, 2]
    assert offsets(store, spark, day="2024-03-03") == []
    assert store.read(spark, "items", "invalid").columns == list(bronze.INVALID_COLUMNS)


def test_a_repeated_batch_replaces_itself(spark, store):
    for _ in range(2):
        store.write(batch(spark, [good(1), "{broken"]), 7)
    assert offsets(store, spark) == [0] and offsets(store, spark, "invalid") == [1]


def test_a_repeated_batch_may_judge_differently(spark, store):
    store.write(batch(spark, [good(1), "{broken"], LENIENT), 7)
    assert offsets(store, spark) == [0, 1]
    store.write(batch(spark, [good(1), "{broken"], STRICT), 7)
    assert offsets(store, spark) == [0] and offsets(store, spark, "invalid") == [1]


def test_batches_of_several_streams_stay(spark, store):
    store.write(batch(spark, [good(1), good(2), good(3)]), 0, "first")
    store.write(batch(spark, [good(1), good(2)]), 0, "second")
    store.write(batch(spark, [good(1)], at="2024-03-08 10:00:00"), 0, "third")  # a new checkpoint, a week later
    assert offsets(store, spark) == [0, 0, 0, 1, 1, 2]
    store.write(batch(spark, [good(1)]), 0, "first")  # repeated, with another outcome
    assert offsets(store, spark, day="2024-03-01") == ([0, 0, 1])


def test_a_closed_day_is_folded_into_few_files(spark, tmp_path):
    store = lake.BronzeFiles(str(tmp_path / "bronze"))
    for i in range(5):
        store.write(batch(spark, [good(1), "{broken"]).unionByName(batch(spark, [good(1)], topic="cdc.public.other")), i, "s")
    store.write(batch(spark, [good(1)], at="2024-03-02 10:00:00"), 5, "s")
    before = {s: offsets(store, spark, s) for s in ("valid", "invalid")}
    assert store.compact_day(spark, "2024-03-01") == 5 and store.compact_day(spark, "2024-02-01") == 0
    assert {s: offsets(store, spark, s) for s in ("valid", "invalid")} == before
    assert offsets(store, spark, table="other") == [0] * 5
    assert len(list((tmp_path / "bronze").glob("_ingest_date=2024-03-01/*/*/_status=valid/_table=items/*.parquet"))) == 1
    store.write(batch(spark, [good(1), "{broken"]), 3, "s")  # the stream repeats a folded batch
    assert {s: offsets(store, spark, s) for s in ("valid", "invalid")} == before
    store.write(batch(spark, [good(7)]), 9, "s")  # a late batch, folded by the next run
    assert store.compact_day(spark, "2024-03-01") == 7
    assert offsets(store, spark, day="2024-03-01") == [0] * 6


def test_folding_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    store = lake.BronzeFiles(str(tmp_path / "bronze"))
    for i in range(3):
        store.write(batch(spark, [good(1)]), i, "s")
    with monkeypatch.context() as patch, pytest.raises(RuntimeError):

        def crash(*_):
            raise RuntimeError

        patch.setattr(lake, "delete_folder", crash)  # after the batches are gone, before the rows are in place
        store.compact_day(spark, "2024-03-01")
    store.compact_day(spark, "2024-03-01")
    assert offsets(store, spark) == [0, 0, 0]


STEPS = ["recovered", "planned", "written", "announced", "placed", "switched", "cleaned"]


@pytest.mark.parametrize("stop", STEPS)
def test_a_fold_that_stops_after_any_step_loses_and_repeats_nothing(spark, tmp_path, stop):
    store = lake.BronzeFiles(str(tmp_path / "bronze"))
    for i in range(3):
        store.write(batch(spark, [good(1), "{broken"]), i, "s")
    steps = store.fold_steps(spark, "2024-03-01")
    for step in steps:
        assert offsets(store, spark) == [0, 0, 0] and offsets(store, spark, "invalid", "2024-03-01") == [1, 1, 1], step
        if step == stop:
            break
    steps.close()
    store.write(batch(spark, [good(1)] * 7), 9, "s")  # a late batch after the stop
    store.write(batch(spark, [good(1), "{broken"]), 1, "s")  # and one that repeats
    expected = [0] * 4 + [1, 2, 3, 4, 5, 6]
    assert offsets(store, spark) == expected
    store.compact_day(spark, "2024-03-01")
    assert offsets(store, spark) == expected and offsets(store, spark, "invalid") == [1, 1, 1]
    store.write(batch(spark, [good(1), "{broken"]), 2, "s")  # folded by now
    store.compact_day(spark, "2024-03-01")
    assert offsets(store, spark) == expected and offsets(store, spark, "invalid") == [1, 1, 1]
    assert sorted(p.name for p in (tmp_path / "bronze" / "_ingest_date=2024-03-01").glob("_stream_id=s/*")) == []


@pytest.mark.parametrize("during", STEPS[1:-1])
def test_batches_that_come_while_a_day_is_folded_stay(spark, tmp_path, during):
    store = lake.BronzeFiles(str(tmp_path / "bronze"))
    for i in range(2):
        store.write(batch(spark, [good(1)]), i, "s")
    for step in store.fold_steps(spark, "2024-03-01"):
        if step == during:
            store.write(batch(spark, [good(1), good(2)]), 5, "s")
            store.write(batch(spark, [good(1)]), 1, "s")  # a repeat is left to the fold
        assert offsets(store, spark) == ([0, 0] if STEPS.index(step) < STEPS.index(during) else [0, 0, 0, 1])
    assert offsets(store, spark) == [0, 0, 0, 1]


def test_a_batch_that_changes_while_it_is_read_stops_the_fold(spark, tmp_path):
    store = lake.BronzeFiles(str(tmp_path / "bronze"))
    store.write(batch(spark, [good(1)]), 0, "s")
    steps = store.fold_steps(spark, "2024-03-01")
    assert [next(steps), next(steps)] == ["recovered", "planned"]
    mark = next((tmp_path / "bronze").glob("*/*/*/_SUCCESS"))
    mark.unlink()  # a writer that looked before the fold was planned has begun
    with pytest.raises(RuntimeError, match="has changed"):
        list(steps)
    assert offsets(store, spark) == [0] and store._folded(spark, "2024-03-01") == set()


def test_a_hot_table_is_folded_by_several_tasks(spark, tmp_path):
    store = lake.BronzeFiles(str(tmp_path / "bronze"))
    for i in range(4):
        store.write(batch(spark, [record("c", {"id": n, "name": f"{n * 7919 % 65537:x}" * 20}) for n in range(i * 2000, i * 2000 + 2000)]), i, "s")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        store.compact_day(spark, "2024-03-01")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(list((tmp_path / "bronze").glob("*/_stream_id=compacted/*/*/_table=items/*.parquet"))) > 1
    assert store.read(spark, "items").count() == 8000


def test_any_topic_can_be_stored_and_read(spark, store):
    store.write(batch(spark, [good(1), good(2)], topic="cdc.public.my-table"), 0)
    assert offsets(store, spark, table="my-table") == [0, 1] and offsets(store, spark, table="my_table") == []


def test_tables_do_not_mix(spark, store):
    rows = batch(spark, [good(1)]).unionByName(batch(spark, [good(1), good(2)], topic="cdc.public.other"))
    store.write(rows, 0)
    assert offsets(store, spark) == [0] and offsets(store, spark, table="other") == [0, 1]


def test_a_file_batch_has_one_ingestion_time(spark, tmp_path):
    store = lake.BronzeFiles(str(tmp_path / "bronze"))
    rows = batch(spark, [good(1)]).unionByName(batch(spark, [good(2)], at="2024-03-02 00:00:00"))
    with pytest.raises(Exception, match="one ingestion time"):
        store.write(rows, 0)


def test_day_read_prunes_to_the_days_folder(spark, tmp_path):
    store = lake.BronzeFiles(str(tmp_path / "bronze"))
    for i, day in enumerate(["2024-03-01", "2024-03-02"]):
        store.write(batch(spark, [good(1)], at=f"{day} 10:00:00"), i)
    frame = store.read(spark, "items", "valid", "2024-03-02")
    assert len(frame.inputFiles()) == 1 and "_ingest_date=2024-03-02" in frame.inputFiles()[0]


def test_ddl():
    assert "PARTITIONED BY (days(_ingested_at))" in lake.bronze_ddl("bronze.items", "valid", "iceberg")
    ddl = lake.bronze_ddl("bronze.items", "invalid")
    assert "items_invalid" in ddl and "`_validation_error` string" in ddl and "_cdc_op" not in ddl
    assert "'write.merge.mode'='merge-on-read'" in lake.silver_ddl("silver.items", ITEMS)
    with pytest.raises(ContractError):
        lake.bronze_ddl("bronze.items; DROP TABLE x", "valid")


def test_silver_table_is_created_from_the_contract(spark):
    lake.create_silver(spark, "created.items", ITEMS)
    lake.create_silver(spark, "created.items", ITEMS)
    table = spark.table("created.items")
    assert table.columns == ["id", "name", "price", "ok", "_cdc_op", "_cdc_ts", "_ingested_at", "_lsn", "_offset", "_partition"]
    assert dict(table.dtypes)["price"] == "double" and table.isEmpty()
    with pytest.raises(ContractError):
        lake.create_silver(spark, "created.keyless", Contract("keyless", (Field("a"),)))


def test_versions_switch_and_old_ones_go(spark):
    name = "versions.numbers"
    for n in (1, 2, 3):
        frame = spark.range(n) if n == 1 else spark.table(name).union(spark.range(1))
        lake.publish_version(spark, name, lake.write_version(spark, frame, name))
    assert spark.table(name).count() == 3
    tables = {t.name for t in spark.catalog.listTables("versions")}
    assert tables == {"numbers", "numbers__v2", "numbers__v3"}


def test_an_unpublished_version_is_invisible(spark):
    name = "unpublished.numbers"
    lake.publish_version(spark, name, lake.write_version(spark, spark.range(1), name))
    lake.write_version(spark, spark.range(9), name)  # a run that died before the switch
    assert spark.table(name).count() == 1
    lake.publish_version(spark, name, lake.write_version(spark, spark.range(2), name))
    assert spark.table(name).count() == 2


def test_schema_change_is_refused(spark):
    name = "fixed.numbers"
    lake.publish_version(spark, name, lake.write_version(spark, spark.range(1), name))
    with pytest.raises(lake.SchemaChanged):
        lake.write_version(spark, spark.range(1).withColumn("more", F.lit(1)), name)


def test_bucketed_version_is_joined_without_a_shuffle_of_it(spark, tmp_path):
    from tidelake.operators.silver import merge_frames

    name = "bucketed.items"
    schema = lake.silver_schema(ITEMS)
    stored = spark.createDataFrame([(i, f"n{i}", 1.0, True, "c", None, None, None, None, None) for i in range(50)], schema)
    lake.publish_version(spark, name, lake.write_version(spark, stored, name, ["id"], buckets=4))
    path = str(tmp_path / "batch")
    stored.filter("id < 30").write.parquet(path)
    merged = merge_frames(spark.table(name), spark.read.parquet(path), ["id"])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    left = plan[plan.index("FullOuter") : plan.index("FileScan")]
    assert "Exchange" not in left
    version = lake.write_version(spark, merged, name, ["id"], buckets=4, aligned=True)
    written = lake.read_version(spark, name, version)
    assert written.count() == 50 and len(written.inputFiles()) <= 4  # one file per bucket, without another shuffle
