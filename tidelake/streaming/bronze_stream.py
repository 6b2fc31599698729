"""The streaming job: change records -> checked bronze pairs."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelake.functions.contracts import BrokenContract, Contract, ContractFolder
from tidelake.operators.bronze import to_bronze
from tidelake.session import build_session
from tidelake.sources import kafka
from tidelake.sources.lake import BronzeFiles, BronzeTables, batch_day, write_counts
from tidelake.streaming.progress import ProgressLog


# The property in which Spark tells a batch the id that it keeps in the checkpoint.
_STREAM_ID = "sql.streaming.queryId"


def start_bronze(
    changes: DataFrame,
    store: BronzeFiles | BronzeTables,
    checkpoint: str,
    contracts: Mapping[str, Contract | BrokenContract] | Callable[[], Mapping[str, Contract | BrokenContract]],
    on_missing_contract: str = "pass",
    interval: str | None = "10 seconds",
    name: str | None = None,
    counts: str | None = None,
) -> StreamingQuery:
    """Start the bronze stream; `interval=None` reads what is there and stops.

    The ingestion time is taken in the streaming plan: Spark keeps it in the checkpoint, so a repeated
    batch gets the same time and overwrites itself. Batches are stored under the id that the checkpoint
    gives the stream. `contracts` may be a function that is called for every batch, so that a new
    contract takes effect without a restart. With `counts`, the numbers of valid and invalid rows of each batch, counted by
    its write, go to the count log in that folder (`BronzeFiles` only).
    """
    stamped = changes.withColumn("_ingested_at", F.current_timestamp())

    def write(batch: DataFrame, batch_id: int) -> None:
        day = batch_day(batch)  # before the records are parsed
        if day is None:
            return
        current = contracts() if callable(contracts) else contracts
        stream_id = batch.sparkSession.sparkContext.getLocalProperty(_STREAM_ID)
        if not stream_id:
            raise RuntimeError("the stream's id is not known in this batch")
        done = store.write(to_bronze(batch, current, on_missing_contract, F.col("_ingested_at")), batch_id, stream_id, day)
        if counts and done:
            write_counts(batch.sparkSession, counts, f"{stream_id}/{batch_id}", [("", name, n) for name, n in done.items()])

    writer = stamped.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()


def add_store_arguments(parser: argparse.ArgumentParser) -> None:
    """Where bronze is: a folder of files, or pairs of catalog tables."""
    store = parser.add_mutually_exclusive_group(required=True)
    store.add_argument("--bronze", help="folder of the bronze files")
    store.add_argument("--bronze-database", help="database of the bronze tables, in place of files")
    parser.add_argument("--bronze-provider", default="parquet", help="table format of the bronze tables")


def store_from(args: argparse.Namespace) -> BronzeFiles | BronzeTables:
    if args.bronze:
        return BronzeFiles(args.bronze)
    return BronzeTables(args.bronze_database, args.bronze_provider)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--servers", required=True, help="Kafka bootstrap servers")
    parser.add_argument("--contracts", required=True, help="folder of contract files")
    add_store_arguments(parser)
    parser.add_argument("--checkpoint", required=True, help="folder of the stream's checkpoint")
    parser.add_argument("--pattern", default=kafka.TOPIC_PATTERN)
    parser.add_argument("--interval", default="10 seconds")
    parser.add_argument("--on-missing-contract", choices=("pass", "fail"), default="pass")
    parser.add_argument("--max-offsets-per-trigger", type=int)
    parser.add_argument("--min-partitions", type=int)
    parser.add_argument("--counts", help="folder of the count log (bronze files only)")
    parser.add_argument("--progress", help="folder for the progress and lag of every trigger")
    args = parser.parse_args(argv)

    spark = build_session("bronze-stream")
    if args.progress:
        spark.streams.addListener(ProgressLog(spark, args.progress))
    changes = kafka.read_stream(
        spark,
        args.servers,
        pattern=args.pattern,
        max_offsets_per_trigger=args.max_offsets_per_trigger,
        min_partitions=args.min_partitions,
    )
    start_bronze(
        changes,
        store_from(args),
        args.checkpoint,
        ContractFolder(spark, args.contracts),
        args.on_missing_contract,
        args.interval,
        counts=args.counts,
    ).awaitTermination()


if __name__ == "__main__":
    main()
