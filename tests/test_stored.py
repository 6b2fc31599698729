"""What is known of stored rows without reading them again: footers, digests, sketches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from tests.helpers import ITEMS, record

from tidelake.operators import bronze, capture, profile
from tidelake.sources.lake import BronzeFiles

DAY = "2024-03-01"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def stored(spark, store, rows, batch, stream="a", day=DAY):
    """(partition, offset, value) rows of one topic as a batch."""
    frame = spark.createDataFrame([("cdc.public.items", v, p, o) for p, o, v in rows], "topic string, value string, partition int, offset long")
    store.write(bronze.to_bronze(frame, {"items": ITEMS}, ingested_at=f"{day} 10:00:00"), batch, stream, day)


def good(i):
    return record("c", {"id": i, "name": "n"})


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


# ---------------------------------------------------------------- footers


def test_offsets_and_counts_from_footers(spark, tmp_path):
    store = BronzeFiles(str(tmp_path / "bronze"))
    stored(spark, store, [(0, i, good(i)) for i in range(5)] + [(0, 7, "{")], 0)
    stored(spark, store, [(1, i, good(i)) for i in range(3, 6)], 1)
    stored(spark, store, [(0, 9, good(9)), (2, 1, good(10))], 2)
    assert rows_of(store.offsets(spark)) == [("items", 0, 0, 10, 7), ("items", 1, 3, 6, 3), ("items", 2, 1, 2, 1)]
    assert rows_of(store.counts(spark)) == [("items", "invalid", 1), ("items", "valid", 10)]
    assert rows_of(store.counts(spark, "2024-03-02")) == []


def test_footers_read_no_column(spark, tmp_path):
    store = BronzeFiles(str(tmp_path / "bronze"))
    stored(spark, store, [(0, i, good(i)) for i in range(5)], 0)
    plan = plan_of(store.counts(spark))
    assert "PushedAggregation: [COUNT(*)" in plan and "_raw_value" not in plan
    plan = plan_of(store.offsets(spark))
    assert "MAX(_offset)" in plan and "MIN(_partition)" in plan and "_raw_value" not in plan


def test_footers_with_nulls_and_without_rows(spark, tmp_path):
    store = BronzeFiles(str(tmp_path / "bronze"))
    assert rows_of(store.counts(spark)) == [] and rows_of(store.offsets(spark)) == []
    stored(spark, store, [(0, 4, good(1)), (None, 5, good(2)), (1, None, good(3))], 0)
    assert rows_of(store.offsets(spark)) == rows_of(
        spark.createDataFrame([("items", 0, 4, 5, 1), ("items", None, 5, 6, 1), ("items", 1, None, None, 1)], "t string, p int, b long, e long, n long")
    )
    assert rows_of(store.counts(spark)) == [("items", "valid", 3)]


def test_footers_while_a_day_is_folded(spark, tmp_path):
    store = BronzeFiles(str(tmp_path / "bronze"))
    for n in range(3):
        stored(spark, store, [(n, i, good(i)) for i in range(4)], n)
    want = [("items", n, 0, 4, 4) for n in range(3)]
    for _ in store.fold_steps(spark, DAY):
        assert rows_of(store.offsets(spark)) == want and rows_of(store.counts(spark)) == [("items", "valid", 12)]


# ---------------------------------------------------------------- digests


def snapshot(spark, rows):
    return spark.createDataFrame(rows, "id long, a string, b string, bucket long")


def as_rows(frame):
    return sorted(frame.select("id", "op", "value").collect())


@pytest.mark.parametrize("layout", [{"buckets": 7}, {"buckets": 1}, {"width": 3}])
def test_diff_by_digest_is_the_diff(spark, layout):
    rng = random.Random(3)

    def some(share):
        return [(i, rng.choice(["x", None, ""]), rng.choice(["x", None, ""]), i) for i in range(-20, 40) if rng.random() < share]

    old, new = snapshot(spark, some(0.8)), snapshot(spark, some(0.8))
    for a, b in ((old, new), (old, old), (old, new.limit(0)), (old.limit(0), new)):
        want = capture.diff_to_cdc(a, b, "items", ["id"], F.lit(1))
        got = capture.diff_by_digest(a, b, "items", ["id"], F.lit(1), **layout)
        assert as_rows(got) == as_rows(want)


def test_digest_sees_which_column_is_null_but_not_their_order(spark):
    rows = snapshot(spark, [(1, None, "x", 0)])
    moved = snapshot(spark, [(1, "x", None, 0)])
    digest = [capture.snapshot_digest(f, ["id"], buckets=4) for f in (rows, moved, rows.select("bucket", "b", "a", "id"))]
    assert capture.differing_buckets(digest[0], digest[1]).count() == 1
    assert capture.differing_buckets(digest[0], digest[2]).count() == 0


def test_only_buckets_that_differ_are_joined(spark, tmp_path):
    old = spark.range(10_000).select("id", F.lit("n").alias("name"))
    new = old.withColumn("name", F.when(F.col("id") == 4711, "m").otherwise(F.col("name")))
    digest = [capture.snapshot_digest(f, ["id"], width=100) for f in (old, new)]
    assert [r.bucket for r in capture.differing_buckets(*digest).collect()] == [47]
    digest[0].write.parquet(str(tmp_path / "digest"))
    stored_digest = spark.read.parquet(str(tmp_path / "digest"))
    got = capture.diff_by_digest(old, new, "items", ["id"], F.lit(1), width=100, old_digest=stored_digest)
    assert [(r.id, r.op) for r in got.collect()] == [(4711, "u")]
    assert plan_of(got).count("bit_xor") < plan_of(capture.diff_by_digest(old, new, "items", ["id"], F.lit(1), width=100)).count("bit_xor")


def test_buckets_need_a_layout(spark):
    for wrong in ({}, {"buckets": 2, "width": 2}):
        with pytest.raises(ValueError):
            capture.bucket_of(["id"], **wrong)
    with pytest.raises(ValueError):
        capture.bucket_of(["a", "b"], width=2)


# ---------------------------------------------------------------- sketches


def test_profiles_of_days_add_up(spark):
    rng = random.Random(5)
    start = datetime.date(2024, 1, 1)
    rows = [
        (start + datetime.timedelta(days=rng.randrange(5)), rng.randrange(-50_000, 50_000), rng.gauss(0, 10), f"s{rng.randrange(700)}" if rng.random() < 0.9 else None, [1])
        for _ in range(20_000)
    ]
    frame = spark.createDataFrame(rows, "day date, k int, x double, s string, list array<int>")
    days = profile.sketch_profile(frame, "day")
    assert days.count() == 5 * 4
    whole = {r.name: r for r in profile.read_profile(profile.unite_profiles(days), 0.1, 0.5, 0.9).collect()}
    ks, xs, ss = sorted(r[1] for r in rows), sorted(r[2] for r in rows), [r[3] for r in rows if r[3]]
    assert (whole["k"].n_rows, whole["k"].n_null, int(whole["k"].low), int(whole["k"].high)) == (20_000, 0, ks[0], ks[-1])
    assert (whole["s"].n_null, whole["s"].low, whole["s"].high) == (20_000 - len(ss), min(ss), max(ss))
    assert (float(whole["x"].low), float(whole["x"].high)) == (xs[0], xs[-1])
    assert whole["k"].n_distinct == pytest.approx(len(set(ks)), rel=0.08) and whole["s"].n_distinct == pytest.approx(700, rel=0.08)
    for name, values in (("k", ks), ("x", xs)):
        for share, found in zip((0.1, 0.5, 0.9), whole[name].quantiles, strict=True):
            assert values[int((share - 0.03) * len(values))] <= found <= values[int((share + 0.03) * len(values))]
    assert whole["list"].n_distinct is None and whole["list"].quantiles is None and whole["list"].low is None and whole["list"].n_null == 0
    twice = profile.unite_profiles(profile.unite_profiles(days, "day"))
    estimates = lambda p: sorted((r.name, r.n_rows, r.low, r.high, r.n_distinct) for r in profile.read_profile(p).where("name <> 'list'").collect())
    assert estimates(twice) == estimates(profile.unite_profiles(days))


def test_profiles_of_nulls_nothing_and_large_numbers(spark):
    schema = "`a.b` long, d date, f double"
    big = 9_007_199_254_740_993
    frame = spark.createDataFrame([(big, None, float("nan")), (big - 1, None, None), (None, None, 1.5)], schema)
    found = {r.name: r for r in profile.read_profile(profile.unite_profiles(profile.sketch_profile(frame)), 0.5).collect()}
    assert (found["a.b"].low, found["a.b"].high, found["a.b"].n_null, found["a.b"].n_distinct) == (str(big - 1), str(big), 1, 2)
    assert (found["d"].low, found["d"].n_null, found["d"].n_distinct) == (None, 3, 0)
    assert (found["f"].n_null, found["f"].quantiles) == (1, [1.5])
    none = profile.read_profile(profile.unite_profiles(profile.sketch_profile(frame.limit(0))), 0.5).collect()
    assert {(r.n_rows, r.low, r.quantiles) for r in none} == {(0, None, None)}
