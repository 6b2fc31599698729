"""Change records derived from table snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.contracts import check_table_name
from tidelake.functions.envelope import change_record

TOPIC_PREFIX = "cdc.public."
REPLICA_IDENTITIES = ("default", "full")


def topic_of(table: str) -> str:
    return TOPIC_PREFIX + check_table_name(table)


def _image(df: DataFrame) -> Column:
    """The row as a record carries it: timestamps as epoch microseconds."""
    kinds = dict(df.dtypes)
    return F.struct(*[F.unix_micros(c).alias(c) if kinds[c] == "timestamp" else F.col(c) for c in df.columns])


def snapshot_to_cdc(
    snapshot: DataFrame, table: str, keys: Sequence[str], ts_ms: Column, wrapped: bool = True
) -> DataFrame:
    """Every row as an initial-snapshot record: `topic`, the key columns, `op = 'r'`, `value`."""
    row = _image(snapshot)
    nothing = F.lit(None).cast(snapshot.select(row.alias("r")).schema["r"].dataType)
    return snapshot.select(
        F.lit(topic_of(table)).alias("topic"),
        *keys,
        F.lit("r").alias("op"),
        change_record(table, F.lit("r"), nothing, row, ts_ms, wrapped=wrapped).alias("value"),
    )


def diff_to_cdc(
    old: DataFrame,
    new: DataFrame,
    table: str,
    keys: Sequence[str],
    ts_ms: Column,
    replica_identity: str = "default",
    wrapped: bool = True,
) -> DataFrame:
    """Records that turn one snapshot into the next: `topic`, the key columns, `op`, `value`.

    A new key is a create, a missing key a delete carrying the old row, a changed row an update, whose
    `before` is filled only under full replica identity. Unchanged rows give nothing. Keys are unique
    per snapshot, so the one full outer join has no hot key.
    """
    if replica_identity not in REPLICA_IDENTITIES:
        raise ValueError(f"replica_identity must be one of {REPLICA_IDENTITIES}")
    before = old.select(*keys, _image(old.select(*new.columns)).alias("_before"))
    after = new.select(*keys, _image(new).alias("_after"))
    joined = before.join(after, list(keys), "full_outer").filter(~F.col("_before").eqNullSafe(F.col("_after")))
    op = (
        F.when(F.col("_before").isNull(), "c").when(F.col("_after").isNull(), "d").otherwise("u")
    )
    nothing = F.lit(None).cast(after.schema["_after"].dataType)
    shown = F.col("_before") if replica_identity == "full" else F.when(op == "d", F.col("_before")).otherwise(nothing)
    return joined.select(
        F.lit(topic_of(table)).alias("topic"),
        *keys,
        op.alias("op"),
        change_record(table, op, shown, F.col("_after"), ts_ms, wrapped=wrapped).alias("value"),
    )


def bucket_of(keys: Sequence[str], buckets: int | None = None, width: int | None = None) -> Column:
    """The bucket of a key: one of `buckets` by hash, or the range of `width` whole numbers it lies in."""
    if (buckets is None) == (width is None) or (width is not None and len(keys) != 1):
        raise ValueError("give the number of buckets, or the width of ranges of a single whole-number key")
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("bigint") if buckets else F.floor(F.col(keys[0]) / F.lit(width)).cast("bigint")


def snapshot_digest(snapshot: DataFrame, keys: Sequence[str], buckets: int | None = None, width: int | None = None) -> DataFrame:
    """(bucket, n_rows, low, high) of a snapshot: the digest of each bucket's rows, whatever their order.

    Two 64-bit hashes of every row, one folded by xor and one summed, so that buckets of equal digests hold equal rows but for
    an accident in 128 bits. Columns count in the order of their names; nulls count with their place. Rows are folded
    before the shuffle. Store it beside the snapshot and the next diff need not hash the old rows again.
    """
    columns = [F.col(c) for c in sorted(snapshot.columns)]
    parts = [part for c in columns for part in (c, c.isNull())]
    rows = snapshot.select(
        bucket_of(keys, buckets, width).alias("bucket"), F.xxhash64(F.lit(1), *parts).alias("h1"), F.xxhash64(F.lit(2), *parts).alias("h2")
    )
    return rows.groupBy("bucket").agg(
        F.count("*").alias("n_rows"), F.bit_xor("h1").alias("low"), F.sum(F.col("h2").cast("decimal(20,0)")).alias("high")
    )


def differing_buckets(old: DataFrame, new: DataFrame) -> DataFrame:
    """The buckets whose digests differ, or that only one snapshot has."""
    was, now = (d.select("bucket", F.struct("n_rows", "low", "high").alias(name)) for d, name in ((old, "was"), (new, "now")))
    return was.join(now, "bucket", "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select("bucket")


def diff_by_digest(
    old: DataFrame,
    new: DataFrame,
    table: str,
    keys: Sequence[str],
    ts_ms: Column,
    buckets: int | None = None,
    width: int | None = None,
    old_digest: DataFrame | None = None,
    replica_identity: str = "default",
    wrapped: bool = True,
) -> DataFrame:
    """The records of `diff_to_cdc`, for large snapshots of which little has changed.

    Only rows of buckets whose digests differ are shuffled and joined. `old_digest` is the `snapshot_digest` that was stored
    with the old snapshot (same columns, buckets and width). Keys are never null.
    """
    old = old.select(*new.columns)
    then = snapshot_digest(old, keys, buckets, width) if old_digest is None else old_digest
    changed = differing_buckets(then, snapshot_digest(new, keys, buckets, width))
    in_bucket = bucket_of(keys, buckets, width)
    name = "_bucket"
    kept = [
        df.withColumn(name, in_bucket).join(changed.withColumnRenamed("bucket", name), name, "left_semi").select(*new.columns)
        for df in (old, new)
    ]
    return diff_to_cdc(*kept, table, keys, ts_ms, replica_identity, wrapped)
