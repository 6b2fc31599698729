"""Silver in key buckets, schema growth, unique rules and offset gaps."""

import random

import pytest
from pyspark.sql import types as T
from tests.helpers import ITEMS, record
from tests.test_jobs import SCHEMA, good, write_bronze

from tidelake.functions.contracts import Contract, Field, Rule
from tidelake.operators import report
from tidelake.operators.silver import unique_clashes
from tidelake.plans import silver_job
from tidelake.plans.silver_job import SilverOptions
from tidelake.sources import keyed, lake

ROW = "id long, name string, _cdc_op string, _cdc_ts timestamp, _ingested_at timestamp, _lsn long, _offset long, _partition int"


def rows(spark, values, path=None, schema=ROW):
    """(id, name, op, lsn) as silver rows; with `path` as a written table."""
    frame = spark.createDataFrame([(i, name, op, None, None, lsn, None, None) for i, name, op, lsn in values], schema)
    if path is None:
        return frame
    frame.write.parquet(str(path))
    return spark.read.parquet(str(path))


def names(table):
    return {r.id: r.name for r in table.collect()}


def files(spark, table, buckets):
    own = spark.table(table.name)
    return {f for b in buckets for f in own.where(own[keyed.BUCKET] == b).inputFiles()}


@pytest.mark.parametrize("width", [None, 10])
def test_a_merge_rewrites_the_buckets_it_touches(spark, tmp_path, width):
    table = keyed.KeyedTable(f"keyed_{width}.items", ["id"], buckets=16, width=width, keep_hours=0.0)
    first = rows(spark, [(i, f"n{i}", "c", 1) for i in range(100)], tmp_path / "first")
    table.create(spark, first.schema)
    every = table.merge(first)
    assert len(every) == (16 if width is None else 10) and names(table.read(spark)) == {i: f"n{i}" for i in range(100)}
    before = files(spark, table, every)
    touched = table.merge(rows(spark, [(3, "new", "u", 2), (4, None, "d", 2), (5, "old", "u", 0), (203, "more", "c", 2)], tmp_path / "second"))
    expected = {**{i: f"n{i}" for i in range(100) if i != 4}, 3: "new", 203: "more"}
    assert names(table.read(spark)) == expected and len(touched) <= 4 and (width is None or touched == [0, 20])
    others = [b for b in every if b not in touched]
    assert files(spark, table, others) < before and not files(spark, table, touched) & before
    plan = spark.table(table.name).where(f"{keyed.BUCKET} in ({touched[0]})")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and keyed.BUCKET in plan
    assert table.merge(rows(spark, [], tmp_path / "none")) == [] and names(table.read(spark)) == expected
    table.merge(rows(spark, [(3, "newest", "u", 3)], tmp_path / "third"))  # what bucket of 3 had two merges ago goes
    assert names(table.read(spark)) == {**expected, 3: "newest"}


def test_a_crash_between_switches_is_completed_by_a_rerun(spark, tmp_path, monkeypatch):
    table = keyed.KeyedTable("keyed_crash.items", ["id"], width=10)
    first = rows(spark, [(i, f"n{i}", "c", 1) for i in range(30)], tmp_path / "first")
    table.create(spark, first.schema)
    table.merge(first)
    batch = rows(spark, [(i, "new", "u", 2) for i in (1, 11, 21)], tmp_path / "second")
    switch = table._switch

    def crash(spark, run, touched):
        switch(spark, run, touched[:1])
        raise RuntimeError

    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(table, "_switch", crash)
        table.merge(batch)
    found = names(table.read(spark))
    assert len(found) == 30 and found[1] == "new" and found[11] == "n11"  # whole buckets, before or after
    table.merge(batch)
    assert names(table.read(spark)) == {**{i: f"n{i}" for i in range(30)}, 1: "new", 11: "new", 21: "new"}


def test_new_buckets_are_added_by_few_statements(spark, tmp_path, monkeypatch):
    table = keyed.KeyedTable("keyed_many.items", ["id"], width=10)
    first = rows(spark, [(i, f"n{i}", "c", 1) for i in range(-60, 240)], tmp_path / "first")
    table.create(spark, first.schema)
    statements, run = [], type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *rest, **named: statements.append(text) or run(self, text, *rest, **named))
    assert table.merge(first) == list(range(-6, 24)) and sum(" ADD " in s for s in statements) == 1
    gone = rows(spark, [(i, None, "d", 2) for i in range(-60, -50)] + [(i, "new", "u", 2) for i in range(0, 240, 10)], tmp_path / "second")
    assert table.merge(gone) == [-6, *range(24)]
    assert names(table.read(spark)) == {i: "new" if i >= 0 and i % 10 == 0 else f"n{i}" for i in range(-50, 240)}


def test_a_bucket_may_lose_all_its_rows(spark, tmp_path):
    table = keyed.KeyedTable("keyed_empty.items", ["id"], width=10)
    first = rows(spark, [(1, "a", "c", 1), (11, "b", "c", 1)], tmp_path / "first")
    table.create(spark, first.schema)
    table.merge(first)
    table.merge(rows(spark, [(1, None, "d", 2)], tmp_path / "second"))
    assert names(table.read(spark)) == {11: "b"}
    table.merge(rows(spark, [(2, "back", "c", 3)], tmp_path / "third"))
    assert names(table.read(spark)) == {11: "b", 2: "back"}


@pytest.mark.parametrize("key_width", [None, 2])
def test_a_day_of_a_grown_contract(spark, tmp_path, key_width):
    store = lake.BronzeFiles(str(tmp_path / "b"))
    early = Contract("items", (Field("id", "long", True, True), Field("gone"), Field("name", "string", True)))
    late = Contract("items", (*early.fields[:1], *early.fields[2:], Field("price", "number")))
    write_bronze(spark, store, [record("c", {"id": i, "name": f"n{i}", "gone": "g"}, 1) for i in range(4)], 0, "2024-03-01 10:00:00", {"items": early})
    write_bronze(spark, store, [record("u", {"id": 1, "name": "new", "price": 2.5}, 2)], 1, "2024-03-02 10:00:00", {"items": late})
    options = SilverOptions(database=f"grown_{key_width}", key_width=key_width)
    for contract, day in ((early, "2024-03-01"), (late, "2024-03-02"), (late, "2024-03-02")):
        silver_job.merge_day(spark, store, contract, day, options=options)
    table = spark.table(f"grown_{key_width}.items")
    found = {r.id: (r.name, r.gone, r.price) for r in table.collect()}
    assert found == {0: ("n0", "g", None), 1: ("new", None, 2.5), 2: ("n2", "g", None), 3: ("n3", "g", None)}


def test_a_type_that_would_lose_values_fails_the_table(spark, tmp_path):
    store = lake.BronzeFiles(str(tmp_path / "b"))
    late = Contract("items", (Field("id", "long", True, True), Field("name", "integer")))
    write_bronze(spark, store, [good(1)], 0, "2024-03-01 10:00:00", {"items": ITEMS})
    write_bronze(spark, store, [record("u", {"id": 1, "name": 5}, 1800000000000)], 1, "2024-03-02 10:00:00", {"items": late})
    options, log = SilverOptions(database="refused"), str(tmp_path / "log")
    silver_job.merge_all(spark, store, {"items": ITEMS}, "2024-03-01", options=options, log=log, run_id="r1")
    outcome = silver_job.merge_all(spark, store, {"items": late}, "2024-03-02", options=options, log=log, run_id="r2")[0]
    assert outcome.status == "failed" and "name: string cannot become int" in outcome.error
    assert "cannot become" in spark.read.parquet(log).where("run_id = 'r2'").first().error
    assert spark.table("refused.items").first()["name"] == "n1"


def test_types_grow_without_loss():
    def schema(**types):
        return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in types.items()])

    grown = lake.grown_schema(schema(a="int", b="float", c="bigint", _cdc_op="string"), schema(a="bigint", b="double", c="int", d="string", _cdc_op="string"))
    assert grown.simpleString() == "struct<a:bigint,b:double,c:bigint,d:string,_cdc_op:string>"
    for old, new in (("bigint", "double"), ("string", "int"), ("double", "bigint"), ("boolean", "string")):
        with pytest.raises(lake.SchemaChanged):
            lake.grown_schema(schema(a=old), schema(a=new))


def clashes(stored, batch):
    """By hand: changes in the order of their claims, again until none is held back any more."""
    held = set()
    while True:
        owner, applied = {}, {}
        for i, name, op, lsn in batch:
            old = next((r for r in stored if r[0] == i), None)
            applied[i] = old is None or lsn >= old[3]
        for i, name, op, _ in stored:
            if op != "d" and name is not None and (not applied.get(i, False) or i in held):
                owner.setdefault(name, i)
        lost = set()
        for i, name, op, _ in sorted(batch, key=lambda r: (r[3] is not None, r[3] or 0, r[0])):
            if op != "d" and name is not None and applied[i] and i not in held and owner.setdefault(name, i) != i:
                lost.add(i)
        if not lost:
            return held
        held |= lost


@pytest.mark.parametrize("seed", range(3))
def test_unique_clashes_against_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    stored = [(i, f"v{i}" if rng.random() < 0.9 else None, "d" if rng.random() < 0.1 else "c", rng.randrange(5)) for i in range(40)]
    batch = [(i, rng.choice([None, *(f"v{n}" for n in range(45))]), rng.choice("uuuud"), rng.randrange(3, 8)) for i in rng.sample(range(55), 30)]
    count = iter(range(1000))

    def written(df):
        path = str(tmp_path / f"w{next(count)}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    found = unique_clashes(rows(spark, stored), rows(spark, batch, tmp_path / "batch"), ["id"], "name", written)
    assert {r.id for r in found.collect()} == clashes(stored, batch)


def test_the_stored_table_is_not_grouped_for_a_unique_rule(spark, tmp_path):
    stored = rows(spark, [(i, f"v{i}", "c", 1) for i in range(50)], tmp_path / "stored")
    plans = []

    def written(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return spark.createDataFrame(df.collect(), df.schema)

    unique_clashes(stored, rows(spark, [(1, "v2", "u", 2)], tmp_path / "batch"), ["id"], "name", written).count()
    reading = [p for p in plans if "stored" in p or "LeftSemi" in p]
    assert reading and all("LeftSemi" in p for p in reading)


def test_rejected_changes_are_kept_by_day(spark, tmp_path):
    store = lake.BronzeFiles(str(tmp_path / "b"))
    contract = Contract("items", ITEMS.fields, (Rule("unique", "id"), Rule("unique", "name")))
    write_bronze(spark, store, [good(1), good(2)], 0, "2024-03-01 10:00:00", {"items": contract})
    write_bronze(spark, store, [record("u", {"id": 2, "name": "n1"}, 1800000000000), good(3)], 1, "2024-03-02 10:00:00", {"items": contract})
    options = SilverOptions(database="kept_back")
    for day, rejected in (("2024-03-01", 0), ("2024-03-02", 1), ("2024-03-02", 1), ("2024-03-01", 0)):
        assert silver_job.merge_day(spark, store, contract, day, options=options).rejected == rejected
    assert names(spark.table("kept_back.items")) == {1: "n1", 2: "n2", 3: "n3"}
    held = spark.table("kept_back.items__rejected").collect()
    assert [(r._key, r._validation_error, str(r._day)) for r in held] == [('{"id":2}', "name: unique", "2024-03-02")]


def test_offset_gaps_against_brute_force(spark):
    rng = random.Random(5)
    kept = [("t", p, o) for p, n in ((0, 200_000), (1, 500)) for o in range(n) if not (p == 0 and (o in (5, 32_767, 32_768, 65_535) or 98_304 <= o < 163_840)) and not (p == 1 and o % 7 == 3)]
    kept += [("t", 0, 9), ("t", 0, 9), ("t", 2, 70_000), (None, None, 3), ("t", 3, None)]
    rng.shuffle(kept)
    found = report.offset_gaps(spark.createDataFrame(kept, "topic string, partition int, offset long")).collect()
    holes = {(r.partition, r.first_missing, r.last_missing) for r in found if r.first_missing is not None}
    wanted = {(0, 5, 5), (0, 32_767, 32_768), (0, 65_535, 65_535), (0, 98_304, 163_839)}
    assert holes == wanted | {(1, o, o) for o in range(500) if o % 7 == 3}
    assert [(r.partition, r.n_repeated) for r in found if r.n_repeated] == [(0, 2)] and all(r.n_missing == r.last_missing - r.first_missing + 1 for r in found if r.first_missing is not None)
    assert report.offset_gaps(spark.createDataFrame([], SCHEMA)).count() == 0
