"""The batch job: one day of bronze -> silver, for one table or all of them."""

from __future__ import annotations

import argparse
import time
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.contracts import BrokenContract, Contract, ContractError, load_contract, load_contracts
from tidelake.operators.bronze import revalidate, valid_rows
from tidelake.operators.quarantine import Ledger, open_rows
from tidelake.operators.report import RUN_LOG_SCHEMA
from tidelake.operators.silver import (
    META_COLUMNS,
    TIMESTAMP_MODES,
    dedup_changes,
    live_rows,
    merge_small_batch,
    parse_envelope,
    unique_clashes,
)
from tidelake.session import build_session, delete_folder, scratch_dir
from tidelake.sources.keyed import KeyedTable
from tidelake.sources.lake import (
    BronzeFiles,
    BronzeTables,
    create_silver,
    grown_schema,
    in_columns,
    merge_into_table,
    publish_version,
    silver_ddl,
    silver_schema,
    write_counts,
    write_version,
)
from tidelake.streaming.bronze_stream import add_store_arguments, store_from


@dataclass(frozen=True)
class SilverOptions:
    database: str = "silver"
    guard: bool = True
    tombstones: bool = True  # deleted keys stay as rows, so that no older change brings one back
    timestamps: str = "long"
    buckets: int | None = None
    row_level: bool = False  # merge in place on a catalog with row-level operations
    count: bool = False
    keep_hours: float = 1.0  # how long readers may use an older version of a table
    key_buckets: int | None = None  # keep the table in so many key buckets, and rewrite those that a batch touches
    key_width: int | None = None  # the same, with ranges of so many numbers of a single key
    ledger: str | None = None  # folder that lists the quarantined records that reprocessing has resolved

    def keyed_table(self, name: str, keys: list[str]) -> KeyedTable | None:
        if self.key_buckets is None and self.key_width is None:
            return None
        return KeyedTable(name, keys, self.key_buckets or 64, self.key_width, self.keep_hours)


@dataclass(frozen=True)
class Outcome:
    table: str
    status: str  # merged, empty or failed
    seconds: float
    rows: int | None = None
    error: str | None = None
    rejected: int = 0  # changes that were held back by a unique rule
    counts: Mapping[str, int] = field(default_factory=dict)  # what the run counted while it wrote


def day_changes(
    spark: SparkSession,
    store: BronzeFiles | BronzeTables,
    contract: Contract,
    day: str,
    reprocess_invalid: bool = False,
    resolved: DataFrame | None = None,
) -> DataFrame:
    """The bronze rows to merge: the day's valid ones, or the quarantined ones that pass by now, without those resolved."""
    if not reprocess_invalid:
        return store.read(spark, contract.table, "valid", day)
    invalid = store.read(spark, contract.table, "invalid", day)
    if resolved is not None:
        invalid = open_rows(invalid, resolved)
    return valid_rows(revalidate(invalid, {contract.table: contract}))


def merge_day(
    spark: SparkSession,
    store: BronzeFiles | BronzeTables,
    contract: Contract | BrokenContract,
    day: str,
    reprocess_invalid: bool = False,
    options: SilverOptions = SilverOptions(),
    run_id: str | None = None,
) -> Outcome:
    """Parse, deduplicate and merge one day of one table. Rerunning any day leaves silver as it is.

    The deduplicated batch is written to the scratch folder first: it is read more than once, and Spark
    then knows its size and decides how to join. The folder goes when the merge is done, or has failed.

    Silver grows with its contract: added fields are null in older rows, a type that holds every value of the stored one
    replaces it, dropped fields stay (null in rows that change later). Any other change fails the table. Changes that
    break a `unique` rule are held back before anything is written.

    With a ledger, reprocessing takes the quarantined rows that are still open and lists what it merged, by `run_id`, after
    the merge: a run that dies in between merges the same rows again, which changes nothing.

    The outcome's counts come from the write of the batch: bronze rows read, those without a row image or key, and changes left
    by deduplication. Tasks that are repeated after an executor is lost may be counted twice in the first two, which lie before
    the shuffle; `n_changes` and `report.offset_gaps` don't depend on that. A row-level merge has no counts.
    """
    start = time.monotonic()
    if isinstance(contract, BrokenContract):
        raise ContractError(contract.reason)
    contract.require_keys()
    ledger = Ledger(options.ledger) if options.ledger and reprocess_invalid else None
    run_id = run_id or f"silver-{day}"
    resolved = ledger.read(spark, contract.table, but_run=f"{run_id}/{day}") if ledger else None
    with _Staging(spark, contract.table) as written:
        bronze = day_changes(spark, store, contract, day, reprocess_invalid, resolved)
        if ledger:
            bronze = written(bronze)  # merged and listed: the same rows, whatever is stored meanwhile
        if bronze.isEmpty():
            return Outcome(contract.table, "empty", time.monotonic() - start)
        outcome = _merge_rows(spark, bronze, contract, day, options, start)
        if ledger:
            ledger.resolve(bronze, contract.table, f"{run_id}/{day}")
    return outcome


def _merge_rows(spark: SparkSession, bronze: DataFrame, contract: Contract, day: str, options: SilverOptions, start: float) -> Outcome:
    keys = contract.require_keys()
    name = f"{options.database}.{contract.table}"
    rejected, counts = 0, {}
    if options.row_level:
        changes = dedup_changes(parse_envelope(bronze, contract, options.timestamps), contract)
        spark.sql(silver_ddl(name, contract, options.timestamps))
        merge_into_table(changes, name, keys, options.guard, options.tombstones)
    else:
        with _Staging(spark, contract.table) as written:
            counted = {c: Observation() for c in ("n_read", "n_keyed", "n_changes")}
            seen = lambda df, counter: df.observe(counted[counter], F.count(F.lit(1)).alias("n"))
            parsed = seen(parse_envelope(seen(bronze, "n_read"), contract, options.timestamps), "n_keyed")
            batch = written(seen(dedup_changes(parsed, contract), "n_changes"))
            counts = {c: o.get.get("n", 0) for c, o in counted.items()}
            counts["n_keyless"] = counts["n_read"] - counts.pop("n_keyed")
            keyed = options.keyed_table(name, keys)
            if keyed:
                keyed.create(spark, silver_schema(contract, options.timestamps))
                schema, stored = keyed.grow(spark, batch.schema), keyed.read(spark)
            else:
                create_silver(spark, name, contract, options.timestamps, options.buckets)
                stored = spark.table(name)
                schema = grown_schema(stored.schema, batch.schema)
            batch, rejected = _unique_only(in_columns(stored, schema), in_columns(batch, schema), contract, day, options, written)
            if keyed:
                keyed.merge(batch, options.guard, options.tombstones)
            else:
                grows = schema != stored.schema
                merged = merge_small_batch(in_columns(stored, schema), batch, keys, options.guard, options.tombstones)
                version = write_version(spark, merged, name, keys, options.buckets, aligned=not grows, grows=grows)
                publish_version(spark, name, version, keep_hours=options.keep_hours)
    rows = live_rows(spark.table(name)).count() if options.count else None
    return Outcome(contract.table, "merged", time.monotonic() - start, rows, rejected=rejected, counts={**counts, "n_rejected": rejected})


class _Staging:
    """Writes frames to the scratch folder and reads them again; the folders go at the end, or when something fails."""

    def __init__(self, spark: SparkSession, table: str) -> None:
        self.spark, self.table, self.paths = spark, table, []

    def __enter__(self) -> _Staging:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self.paths.append(scratch_dir(self.spark, f"silver-{self.table}"))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete_folder(self.spark, path)


def _unique_only(
    stored: DataFrame, batch: DataFrame, contract: Contract, day: str, options: SilverOptions, written: _Staging
) -> tuple[DataFrame, int]:
    """The changes that break no `unique` rule of the contract, and how many are held back.

    Those go to `<table>__rejected`, by day, with the rule; a rerun of the day replaces them. A rule on the key itself holds
    by the merge.
    """
    keys = contract.require_keys()
    columns = [c for c in contract.unique if [c] != keys]
    if not columns:
        return batch, 0
    held_back = None
    for column in columns:
        held = unique_clashes(stored, batch, keys, column, written)
        rows = batch.join(held, keys, "left_semi").withColumn("_validation_error", F.lit(f"{column}: unique"))
        held_back = rows if held_back is None else held_back.unionByName(rows)
        batch = batch.join(held, keys, "left_anti")
    held_back, batch = written(held_back), written(batch)
    count = held_back.count()
    _reject(held_back, f"{options.database}.{contract.table}__rejected", keys, day)
    return batch, count


def _reject(rows: DataFrame, name: str, keys: list[str], day: str) -> None:
    spark = rows.sparkSession
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (`_key` string, `_row` string, `_validation_error` string, `_cdc_op` string, "
        "`_cdc_ts` timestamp, `_ingested_at` timestamp, `_partition` int, `_offset` bigint, `_day` date) USING parquet PARTITIONED BY (`_day`)"
    )
    spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (`_day`=DATE'{day}')")
    own = [c for c in rows.columns if c not in (*META_COLUMNS, "_validation_error")]
    rows.select(
        F.to_json(F.struct(*keys)),
        F.to_json(F.struct(*own)),
        "_validation_error",
        "_cdc_op",
        "_cdc_ts",
        "_ingested_at",
        "_partition",
        "_offset",
        F.lit(day).cast("date"),
    ).write.insertInto(name)


def merge_all(
    spark: SparkSession,
    store: BronzeFiles | BronzeTables,
    contracts: Mapping[str, Contract | BrokenContract],
    day: str,
    reprocess_invalid: bool = False,
    options: SilverOptions = SilverOptions(),
    at_once: int = 4,
    log: str | None = None,
    run_id: str | None = None,
    counts: str | None = None,
) -> list[Outcome]:
    """Every table that has a contract, a few at a time; a table that fails does not stop the others.

    With `log`, the outcomes are appended to the run log in that folder; with `counts`, their counts go to that count log.
    """
    run_id = run_id or f"silver-{day}"

    def one(table: str) -> Outcome:
        start = time.monotonic()
        try:
            return merge_day(spark, store, contracts[table], day, reprocess_invalid, options, run_id)
        except Exception as error:  # reported per table, see run_log
            return Outcome(table, "failed", time.monotonic() - start, error=f"{type(error).__name__}: {error}")

    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        outcomes = list(pool.map(one, sorted(contracts)))
    if log:
        append_log(log, run_log(spark, run_id, outcomes))
    if counts:
        write_counts(spark, counts, f"{run_id}/{day}", [(o.table, c, n) for o in outcomes for c, n in o.counts.items()])
    return outcomes


def run_log(spark: SparkSession, run_id: str, outcomes: list[Outcome], layer: str = "silver") -> DataFrame:
    """The outcomes as rows for the append-only run log that `report.run_report` reads."""
    rows = [
        (run_id, o.table, i, f"{layer}:{o.table}", o.seconds, 0.0 if o.error else 1.0, o.error)
        for i, o in enumerate(outcomes)
    ]
    return spark.createDataFrame(rows, RUN_LOG_SCHEMA)


def append_log(folder: str, rows: DataFrame) -> None:
    rows.coalesce(1).write.mode("append").parquet(folder)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--table", help="one table; all tables with a contract if left out")
    parser.add_argument("--date", required=True, help="ingestion day, YYYY-MM-DD")
    parser.add_argument("--contracts", required=True, help="folder of contract files")
    add_store_arguments(parser)
    parser.add_argument("--database", default="silver")
    parser.add_argument("--reprocess-invalid", action="store_true")
    parser.add_argument("--hard-delete", action="store_true", help="drop deleted keys; older changes then bring them back")
    parser.add_argument("--timestamps", choices=TIMESTAMP_MODES, default="long")
    parser.add_argument("--key-buckets", type=int, help="keep tables in key buckets and rewrite only those a batch touches")
    parser.add_argument("--key-width", type=int, help="the same, with ranges of so many numbers of a single key")
    parser.add_argument("--keep-hours", type=float, default=1.0, help="how long readers may use an older version")
    parser.add_argument("--log", help="folder of the run log")
    parser.add_argument("--counts", help="folder of the count log")
    parser.add_argument("--ledger", help="folder that lists the quarantined records that reprocessing has resolved")
    parser.add_argument("--run-id")
    parser.add_argument("--row-level", action="store_true")
    parser.add_argument("--buckets", type=int)
    args = parser.parse_args(argv)

    spark = build_session("silver-merge")
    if args.table:  # no other table's file is read
        contracts = {args.table: load_contract(spark, args.contracts, args.table)}
    else:
        contracts = load_contracts(spark, args.contracts)
    options = SilverOptions(
        database=args.database,
        tombstones=not args.hard_delete,
        timestamps=args.timestamps,
        keep_hours=args.keep_hours,
        row_level=args.row_level,
        buckets=args.buckets,
        key_buckets=args.key_buckets,
        key_width=args.key_width,
        ledger=args.ledger,
        count=True,
    )
    outcomes = merge_all(
        spark,
        store_from(args),
        contracts,
        args.date,
        args.reprocess_invalid,
        options,
        log=args.log,
        run_id=args.run_id,
        counts=args.counts,
    )
    for outcome in outcomes:
        print(outcome)
    if any(o.error for o in outcomes):
        raise SystemExit(1)


if __name__ == "__main__":
    main()
