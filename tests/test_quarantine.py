"""Quarantine that closes, counts that a run makes while it writes, and the progress log of a stream."""

import pytest
from tests.helpers import ITEMS, record

from tidelake.functions.contracts import Contract, Field
from tidelake.operators import bronze, quarantine
from tidelake.plans import silver_job
from tidelake.plans.silver_job import SilverOptions
from tidelake.sources.lake import BronzeFiles, read_counts
from tidelake.streaming.progress import progress_rows

DAY = "2024-03-01"
WRONG = Contract("items", (Field("id", "long", True, True), Field("name", "integer")))
KEY = "_source_topic string, _partition int, _offset bigint, _raw_value string"


def good(i):
    return record("c", {"id": i, "name": f"n{i}"}, ts_ms=1700000000000 + i)


def write(spark, store, values, contract, batch=0):
    rows = [("cdc.public.items", v, 0, 100 * batch + i) for i, v in enumerate(values)]
    changes = spark.createDataFrame(rows, "topic string, value string, partition int, offset bigint")
    return store.write(bronze.to_bronze(changes, {"items": contract}, ingested_at=f"{DAY} 10:00:00"), batch)


def counts(spark, store, folder):
    resolved = quarantine.Ledger(folder).read(spark, "items")
    read = lambda status: store.read(spark, "items", status)
    return tuple(quarantine.quarantine_counts(read("valid"), read("invalid"), resolved).first())


def test_quarantine_closes_and_reruns_change_nothing(spark, tmp_path):
    store, ledger = BronzeFiles(str(tmp_path / "b")), str(tmp_path / "ledger")
    assert write(spark, store, [good(1), "{broken", good(2)], WRONG) == {"n_valid": 0, "n_invalid": 3}
    options = SilverOptions(database="closing", ledger=ledger)
    assert counts(spark, store, ledger) == (0, 3, 0, 3)
    for run, status in (("a", "merged"), ("a", "merged"), ("b", "empty"), ("a", "merged")):
        assert silver_job.merge_day(spark, store, ITEMS, DAY, True, options, run).status == status
        assert counts(spark, store, ledger) == (0, 1, 2, 3)
    write(spark, store, [good(3), good(4)], WRONG, 1)
    assert counts(spark, store, ledger) == (0, 3, 2, 5)
    assert silver_job.merge_day(spark, store, ITEMS, DAY, True, options, "b").counts["n_read"] == 2  # the new ones only
    assert counts(spark, store, ledger) == (0, 1, 4, 5)
    assert spark.table("closing.items").count() == 4


def test_a_run_that_dies_before_the_ledger_is_done_again(spark, tmp_path, monkeypatch):
    store, ledger = BronzeFiles(str(tmp_path / "b")), str(tmp_path / "ledger")
    write(spark, store, [good(1)], WRONG)
    options = SilverOptions(database="dying", ledger=ledger)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(quarantine.Ledger, "resolve", die)
        with pytest.raises(RuntimeError):
            silver_job.merge_day(spark, store, ITEMS, DAY, True, options, "a")
    assert counts(spark, store, ledger) == (0, 1, 0, 1)
    silver_job.merge_day(spark, store, ITEMS, DAY, True, options, "b")
    assert counts(spark, store, ledger) == (0, 0, 1, 1) and spark.table("dying.items").count() == 1


def test_records_without_a_place_are_known_by_their_text(spark):
    rows = [("t", 0, 1, "a"), ("t", 0, 2, "a"), ("t", None, None, "a"), ("t", None, None, "b"), (None, None, None, None)]
    invalid = spark.createDataFrame(rows, KEY)
    done = quarantine.record_keys(invalid.where("_offset = 2 OR _raw_value = 'b' OR _raw_value IS NULL"))
    done = done.select(*[done[f"_key_{c}"].alias(c) for c in quarantine.RECORD_KEY])
    assert sorted(quarantine.open_rows(invalid, done).collect(), key=str) == sorted([rows[0], rows[2]], key=str)
    assert quarantine.resolved_rows(invalid, done).count() == 3
    assert quarantine.open_rows(invalid, done.limit(0)).count() == 5


def test_ids_of_runs_do_not_meet(spark, tmp_path):
    ledger = quarantine.Ledger(str(tmp_path))
    for i, run in enumerate(("a/b", "a_b", "a-b")):
        ledger.resolve(spark.createDataFrame([("t", 0, i, "x")], KEY), "items", run)
    assert ledger.read(spark, "items").count() == 3
    assert {r["offset"] for r in ledger.read(spark, "items", "a_b").collect()} == {0, 2}
    assert ledger.read(spark, "others").count() == 0


def test_counts_of_rows_without_key_and_of_changes(spark, tmp_path):
    loose = Contract("items", (Field("id", "long", False, True), Field("name", "string")))
    store, log = BronzeFiles(str(tmp_path / "b")), str(tmp_path / "counts")
    values = [good(1), good(1), good(2), record("c", {"name": "no key"}), record("c", None)]
    stored = write(spark, store, values, loose)
    for _ in range(2):  # a repeated run replaces its counts
        silver_job.merge_all(spark, store, {"items": loose}, DAY, options=SilverOptions(database="counted"), counts=log, run_id="r")
    found = {r["counter"]: r["n"] for r in read_counts(spark, log).collect()}
    assert found == {"n_read": stored["n_valid"], "n_keyless": stored["n_valid"] - 3, "n_changes": 2, "n_rejected": 0}
    assert read_counts(spark, log).count() == 4


def test_progress_rows_of_sources_with_and_without_partitions():
    kafka = {"description": "k", "numInputRows": 5, "latestOffset": '{"t": {"0": 9, "1": 4}}', "endOffset": {"t": {"0": 7}}}
    files = {"description": "f", "numInputRows": 2, "latestOffset": None, "endOffset": {"logOffset": 3}}
    rows = progress_rows({"id": "q", "runId": "r", "batchId": 1, "timestamp": "now", "sources": [kafka, files]})
    assert [r[4:] for r in rows] == [("k", 5, "t", 0, 7, 9, 2), ("k", 5, "t", 1, 0, 4, 4), ("f", 2, None, None, None, None, None)]
