"""Silver: the latest row per key, merged into a keyed table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.contracts import Contract
from tidelake.functions.envelope import parse_records

META_COLUMNS = ("_cdc_op", "_cdc_ts", "_ingested_at", "_lsn", "_offset", "_partition")
ORDER_COLUMNS = ("_cdc_ts", "_lsn", "_offset", "_partition")
TIMESTAMP_MODES = ("long", "timestamp")


def silver_columns(contract: Contract) -> list[str]:
    return [f.name for f in contract.fields] + list(META_COLUMNS)


def parse_envelope(bronze: DataFrame, contract: Contract, timestamps: str = "long") -> DataFrame:
    """Contract fields out of `_raw_value`, plus the metadata and ordering columns.

    Each field is read as text and cast on its own, so `12.30` and `"12.30"` both work and one odd
    value does not null the row. Rows without a full primary key are dropped. The raw text ends here.
    `timestamps="timestamp"` turns epoch-microsecond fields into timestamps.
    """
    if timestamps not in TIMESTAMP_MODES:
        raise ValueError(f"timestamps must be one of {TIMESTAMP_MODES}")
    keys = contract.require_keys()
    parsed = parse_records(bronze, "_raw_value", contract.text_struct(), check=False)
    fields = []
    for field in contract.to_struct().fields:
        column = F.col("_image")[field.name].try_cast(field.dataType)
        declared = next(f.type for f in contract.fields if f.name == field.name)
        if declared == "timestamp" and timestamps == "timestamp":
            column = F.timestamp_micros(column)
        fields.append(column.alias(field.name))

    def optional(name: str, kind: str) -> Column:
        return (F.col(name) if name in bronze.columns else F.lit(None)).cast(kind).alias(name)

    rows = parsed.select(
        *fields,
        *META_COLUMNS[:3],
        F.col("_lsn").try_cast("bigint").alias("_lsn"),
        optional("_offset", "bigint"),
        optional("_partition", "int"),
    )
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    return rows


def newest_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER_COLUMNS) -> list[Column]:
    """A total order: the given columns, then every other column, so reruns pick the same row."""
    leading = [c for c in order if c in df.columns]
    rest = [c for c in df.columns if c not in leading and c not in keys]
    return [F.col(c).desc_nulls_last() for c in leading + rest]


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None
) -> DataFrame:
    """One row per key, the first in `order` (default: newest change first).

    `row_number() = 1` lets Spark keep one row per key in every map task before the shuffle, so a
    key that holds a third of the rows sends one row per task.
    """
    order = list(order) if order is not None else newest_first(df, keys)
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") == 1).drop("_rank")


def dedup_changes(df: DataFrame, contract: Contract) -> DataFrame:
    """The latest change per primary key, in the columns of the silver table."""
    return latest_per_key(df, contract.require_keys()).select(*silver_columns(contract))


def newer(source: str, target: str, columns: Sequence[str], keys: Sequence[str]) -> Column:
    """Whether the incoming row stands at or after the stored one in the order that dedup uses.

    Time, then log position, offset and partition, then every other column: one struct each, in which nulls
    come lowest. So it does not matter in which order runs see two changes of a key.
    """
    leading = [c for c in ORDER_COLUMNS if c in columns]
    order = leading + [c for c in columns if c not in leading and c not in keys]
    place = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in order])
    return place(source) >= place(target)


def merge_frames(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    guard: bool = True,
    tombstones: bool = False,
) -> DataFrame:
    """The target after merging deduplicated changes: one full outer join on the key.

    Matched deletes remove the row, other matches replace it, unmatched non-deletes are inserted.
    `guard` keeps a stored row that is newer than the change, by the order of `newest_first`. `tombstones` keeps deleted keys as rows
    with `_cdc_op = 'd'`, so an older change arriving in a later run cannot bring a key back.
    """
    columns = target.columns
    old = target.select(*keys, F.struct(*columns).alias("_old"))
    new = source.select(*keys, F.struct(*columns).alias("_new"))
    return _resolve(old.join(new, list(keys), "full_outer"), columns, keys, guard, tombstones)


def merge_small_batch(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    guard: bool = True,
    tombstones: bool = False,
) -> DataFrame:
    """The same result for a batch small enough that Spark broadcasts it: the target is not shuffled.

    Stored rows look their change up; changes whose key is not stored are added. The second look at
    the target reads its key columns only. `source` is read several times: give it a written table.
    """
    columns = target.columns
    keys = list(keys)
    old = target.select(*keys, F.struct(*columns).alias("_old"))
    new = source.select(*keys, F.struct(*columns).alias("_new"))
    kept = _resolve(old.join(new, keys, "left"), columns, keys, guard, tombstones)
    stored = target.select(*keys).join(source.select(*keys), keys, "left_semi")
    added = source.join(stored, keys, "left_anti").select(*columns)
    if not tombstones:
        added = added.filter(F.col("_cdc_op") != "d")
    return kept.unionByName(added)


def _resolve(
    joined: DataFrame, columns: Sequence[str], keys: Sequence[str], guard: bool, tombstones: bool
) -> DataFrame:
    wins = newer("_new", "_old", columns, keys) if guard else F.lit(True)
    replace = F.col("_new").isNotNull() & (F.col("_old").isNull() | wins)
    row = F.when(replace, F.col("_new")).otherwise(F.col("_old"))
    result = joined.select(F.when(replace, True).otherwise(False).alias("_replaced"), row.alias("_row"))
    if not tombstones:
        result = result.filter(~(F.col("_replaced") & (F.col("_row._cdc_op") == "d")))
    return result.select(*[F.col(f"_row.{c}").alias(c) for c in columns])


def live_rows(silver: DataFrame) -> DataFrame:
    """Rows that are not deleted; a no-op on tables merged without tombstones."""
    return silver.filter(F.col("_cdc_op") != "d")


def unique_clashes(
    stored: DataFrame, batch: DataFrame, keys: Sequence[str], column: str, written: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The keys of deduplicated changes that would give a value of `column` to a second live row.

    A value belongs to the stored row that has it, unless a change takes it away, then to the earliest change that claims it. A
    change that is held back leaves its stored row as it is, with the value it has, so this is repeated until no more
    are held back. Null values, deletes and changes older than the stored row claim nothing. Of the stored
    table only rows with a key or value of the batch are kept, and only these are grouped. `written` puts a frame aside and
    reads it again, so that rounds do not repeat each other's work.
    """
    keys = list(keys)
    order = [c for c in ORDER_COLUMNS if c in batch.columns]
    slim = lambda df: df.select(*keys, F.col(column).alias("_value"), F.col("_cdc_op").alias("_op"), F.struct(*order).alias("_order"))
    changes = slim(batch)
    values = changes.where((F.col("_op") != "d") & F.col("_value").isNotNull()).select("_value").distinct()
    by_key = slim(stored).join(changes.select(*keys), keys, "left_semi").withColumn("_met", F.lit(True))
    by_value = slim(stored).join(values, "_value", "left_semi").join(changes.select(*keys), keys, "left_anti")
    near = by_key.unionByName(by_value.where(F.col("_op") != "d").withColumn("_met", F.lit(False)).select(*by_key.columns))

    # A row kept as deleted has no value, but an older change does not apply to it either.
    old = near.where("_met").select(*keys, F.when(F.col("_op") != "d", F.col("_value")).alias("_old"), F.col("_order").alias("_old_order"))
    told = changes.join(old, keys, "left").withColumn("_applies", F.col("_old_order").isNull() | (F.col("_order") >= F.col("_old_order")))
    told = written(told)
    claims = told.where(F.col("_applies") & (F.col("_op") != "d") & F.col("_value").isNotNull()).select(*keys, "_value", F.lit(1).alias("_turn"), "_order")
    others = written(near.where(~F.col("_met") & F.col("_value").isNotNull()).select(*keys, "_value", F.lit(0).alias("_turn"), "_order"))
    # What stays if a change is held back, or is none that applies.
    stays = told.where(F.col("_old").isNotNull()).select(*keys, F.col("_old").alias("_value"), F.lit(0).alias("_turn"), F.col("_old_order").alias("_order"), "_applies")
    held = written(claims.select(*keys).where(F.lit(False)))
    while True:
        kept = stays.where(~F.col("_applies")).unionByName(stays.where("_applies").join(held, keys, "left_semi")).drop("_applies")
        claiming = claims.join(held, keys, "left_anti")
        place = F.struct("_turn", "_order", *keys)
        all_claims = others.unionByName(kept).unionByName(claiming)
        first = all_claims.groupBy("_value").agg(F.min(place).alias("_first"))
        lost = written(claiming.join(first, "_value").where(place != F.col("_first")).select(*keys))
        if lost.isEmpty():
            return held
        held = written(held.unionByName(lost))
