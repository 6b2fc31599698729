"""The plans that matter at scale, as Spark makes them."""

import re

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F
from tests.helpers import changes

from tidelake.functions.contracts import Contract, Field
from tidelake.functions.rules import with_rules
from tidelake.operators import bronze, consume, silver
from tidelake.operators.profile import profile_columns
from tidelake.sources import kafka

SMALL = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["contract_errors", "reprocess_invalid", "silver_merge", "silver_merge_delete", "gold_customers_orders"])
def test_records_meet_rules_by_table(spark, name):
    plan = plan_of(entry.queries()[name](spark, SMALL))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_merge_reads_the_staged_batch_only(spark):
    plan = plan_of(entry.queries()["silver_merge_delete"](spark, SMALL))
    assert plan.count("merge-changes") <= 3 and "from_json" not in plan


def test_the_quarantine_is_judged_once_before_it_is_reprocessed(spark):
    plan = entry.queries()["reprocess_invalid"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(ArrayType(") == 1 and "to_json" not in plan


def test_a_rule_looks_its_text_up_once(spark):
    rows = bronze.to_bronze(changes(spark, ["{}"]), many_contracts(2, 3))
    assert len(re.findall(r"_image#\d+\[", rows._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_two_streams_run_at_once(spark, monkeypatch):
    steps = []

    class Stream:
        def __init__(self, *_, **__):
            steps.append("start")

        def awaitTermination(self):
            steps.append("wait")

    monkeypatch.setattr(entry, "start_bronze", Stream)
    assert entry.queries()["bronze_two_streams_counts"](spark, SMALL).count() == 0 and steps == ["start", "start", "wait", "wait"]


def many_contracts(n, fields):
    return {f"t{i}": Contract(f"t{i}", tuple(Field(f"f{j}", "long") for j in range(fields))) for i in range(n)}


def test_rules_are_broadcast_by_their_size(spark):
    """60,000 rules: Spark's estimate follows their number, and its own limit decides."""
    rows = changes(spark, ["{}"]).withColumn("_table", F.substring_index("topic", ".", -1))
    few, many = with_rules(rows, many_contracts(3, 4)), with_rules(rows, many_contracts(1000, 60))
    assert "BroadcastHashJoin" in plan_of(few)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        plan = plan_of(with_rules(rows, many_contracts(1000, 60)))
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert many.count() == 1


def test_estimates_exclude_no_key(spark, monkeypatch):
    """Even if every estimate were far too low, the unique column is found."""
    monkeypatch.setattr(F, "approx_count_distinct", lambda *_: F.lit(1))
    frame = spark.range(100).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"))
    assert [r["name"] for r in profile_columns(frame).collect() if r["is_primary_key"]] == ["b"]


def test_ops_are_not_cut_off(spark):
    frame = spark.range(40).select(F.concat(F.lit("op"), "id").alias("_cdc_op"))
    assert consume.distinct_ops(frame).count() == 40 and consume.distinct_ops(frame, 10).count() == 10


def test_preview(spark):
    frame = spark.range(30).select((29 - F.col("id")).alias("n"))
    assert [r["n"] for r in consume.preview(frame, 3, "n").collect()] == [0, 1, 2]
    assert consume.preview(frame, 3).count() == 3


def test_bounded_read_takes_one_partition_from_an_offset(spark, monkeypatch):
    """The connector is not on this class path; what it is asked for is."""
    asked = {}

    class Reader:
        def format(self, name):
            asked["format"] = name
            return self

        def options(self, **options):
            asked.update(options)
            return self

        def load(self):
            return spark.createDataFrame([("t", 2, o) for o in range(100, 130)], "topic string, partition int, offset long")

    class Session:
        read = Reader()

    rows = kafka.read_bounded(Session(), "host:9092", "cdc.public.items", 2, 100, 5).collect()
    assert [r["offset"] for r in rows] == [100, 101, 102, 103, 104]
    assert asked["format"] == "kafka" and asked["kafka.bootstrap.servers"] == "host:9092"
    assert asked["assign"] == '{"cdc.public.items": [2]}'
    assert asked["startingOffsets"] == '{"cdc.public.items": {"2": 100}}' and asked["endingOffsets"] == '{"cdc.public.items": {"2": -1}}'


def test_order_of_merge_has_no_ties(spark):
    """Nulls come lowest, and what differs in any column decides."""
    schema = "id int, name string, _cdc_op string, _cdc_ts timestamp, _ingested_at timestamp, _lsn long, _offset long, _partition int"
    one = spark.createDataFrame([(1, "a", "u", None, None, None, 5, 0)], schema)
    two = spark.createDataFrame([(1, "b", "u", None, None, 1, None, 0)], schema)
    for first, second in ((one, two), (two, one)):
        assert silver.merge_frames(first, second, ["id"]).first()["name"] == "b"
