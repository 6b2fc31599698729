"""Pipeline reports: layer reconciliation, run report, offsets and lag."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.operators.bronze import routing_counts
from tidelake.operators.consume import table_counts

#: Positions of one of Spark's bitmaps.
_BLOCK = 32_768

RUN_LOG_SCHEMA = (
    "run_id string, table_name string, seq bigint, stage string, "
    "seconds double, score double, error string"
)


#: Counts that a stage made while it worked.
COUNT_LOG_SCHEMA = "run_id string, table_name string, counter string, n bigint"


def layer_counts(
    bronze: DataFrame, silver: Mapping[str, DataFrame], gold: Mapping[str, DataFrame]
) -> DataFrame:
    """Rows per layer and table: `layer`, `table_name`, `n_rows`. Bronze is counted in one pass."""
    per_table = routing_counts(bronze).select(
        F.concat(F.lit("bronze_"), "_status").alias("layer"), F.col("_table").alias("table_name"), "n_rows"
    )
    for layer, tables in (("silver", silver), ("gold", gold)):
        if tables:
            per_table = per_table.unionByName(
                table_counts(tables).select(F.lit(layer).alias("layer"), "table_name", "n_rows")
            )
    return per_table


def run_report(run_log: DataFrame) -> DataFrame:
    """One row per run: status, total seconds, whether every score reached 1.0, and where it stopped.

    `last_stage` is the last stage logged, `error` the error logged last. Seconds are summed as
    decimals so the total does not depend on row order.
    """
    failed = F.col("error").isNotNull()
    return run_log.groupBy("run_id").agg(
        F.when(F.bool_or(failed), "ERROR").otherwise("SUCCESS").alias("status"),
        F.count("*").alias("n_stages"),
        F.sum(F.col("seconds").cast("decimal(18,3)")).cast("double").alias("total_seconds"),
        F.coalesce(F.bool_and(F.col("score") >= 1.0), F.lit(True)).alias("passed"),
        F.max_by("stage", F.struct("seq", "stage")).alias("last_stage"),
        F.max_by("error", F.when(failed, F.struct("seq", "stage"))).alias("error"),
    )


def stage_seconds(run_log: DataFrame) -> DataFrame:
    """Seconds per run and stage."""
    return run_log.groupBy("run_id", "stage").agg(
        F.sum(F.col("seconds").cast("decimal(18,3)")).cast("double").alias("seconds")
    )


def list_topics(changes: DataFrame, pattern: str = "cdc") -> DataFrame:
    """Topic names that match a regular expression."""
    return changes.select("topic").distinct().filter(F.col("topic").rlike(pattern))


def topic_offsets(changes: DataFrame) -> DataFrame:
    """Per topic and partition: first offset, next offset, number of records."""
    return changes.groupBy("topic", "partition").agg(
        F.min("offset").alias("begin_offset"),
        (F.max("offset") + 1).alias("end_offset"),
        F.count("*").alias("n_records"),
    )


def offset_islands(changes: DataFrame) -> DataFrame:
    """(topic, partition, first, last, n_records) of every run of offsets without a hole.

    Offsets are folded to bitmaps of 32,768 positions before the shuffle, in every map task. A bitmap without a hole
    between its ends is one run; only the records of the others are looked at one by one. Null offsets take no part.
    """
    records = changes.where(F.col("offset").isNotNull()).select("topic", "partition", "offset")
    block = F.floor(F.col("offset") / _BLOCK).cast("bigint").alias("block")
    folded = records.groupBy("topic", "partition", block).agg(
        F.min("offset").alias("first"),
        F.max("offset").alias("last"),
        F.count("*").alias("n_records"),
        F.bitmap_count(F.bitmap_construct_agg(F.pmod("offset", F.lit(_BLOCK)))).alias("n_offsets"),
    )
    whole = F.col("n_offsets") == F.col("last") - F.col("first") + 1
    runs = folded.where(whole).select("topic", "partition", "first", "last", "n_records")
    holed = folded.where(~whole).select("topic", "partition", "block")
    single = records.withColumn("block", block).join(holed, ["topic", "partition", "block"], "left_semi")
    single = single.groupBy("topic", "partition", "block", "offset").agg(F.count("*").alias("n"))
    in_block = Window.partitionBy("topic", "partition", "block").orderBy("offset")
    run = (F.col("offset") - F.row_number().over(in_block)).alias("run")
    pieces = single.select("topic", "partition", "block", "offset", "n", run).groupBy("topic", "partition", "block", "run")
    pieces = pieces.agg(F.min("offset").alias("first"), F.max("offset").alias("last"), F.sum("n").alias("n_records"))
    # Runs of neighbouring blocks go on where they touch: a row for each hole or block is left by now.
    parts = runs.unionByName(pieces.select(*runs.columns))
    along = Window.partitionBy("topic", "partition").orderBy("first")
    begins = F.coalesce(F.col("first") != F.lag("last").over(along) + 1, F.lit(True)).cast("int")
    numbered = parts.withColumn("begins", begins).withColumn("island", F.sum("begins").over(along))
    return numbered.groupBy("topic", "partition", "island").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n_records").alias("n_records")
    ).drop("island")


def offset_gaps(changes: DataFrame) -> DataFrame:
    """(topic, partition, first_missing, last_missing, n_missing, n_repeated): proof that nothing is lost, or what is.

    A row for each hole between the offsets that are there, and one per partition for records that are there more often than
    once (without a hole's columns). A partition without either has no row. Give it valid and invalid bronze rows together.
    """
    islands = offset_islands(changes)
    along = Window.partitionBy("topic", "partition").orderBy("first")
    holes = islands.withColumn("after", F.lead("first").over(along)).where(F.col("after").isNotNull())
    holes = holes.select(
        "topic",
        "partition",
        (F.col("last") + 1).alias("first_missing"),
        (F.col("after") - 1).alias("last_missing"),
        (F.col("after") - F.col("last") - 1).alias("n_missing"),
        F.lit(0).cast("bigint").alias("n_repeated"),
    )
    spare = F.sum(F.col("n_records") - (F.col("last") - F.col("first") + 1)).alias("n_repeated")
    repeated = islands.groupBy("topic", "partition").agg(spare).where(F.col("n_repeated") > 0)
    none = F.lit(None).cast("bigint")
    return holes.unionByName(
        repeated.select("topic", "partition", none.alias("first_missing"), none.alias("last_missing"), F.lit(0).cast("bigint").alias("n_missing"), "n_repeated")
    )


def stream_lag(offsets: DataFrame, committed: DataFrame) -> DataFrame:
    """Records not yet read per partition: end offset minus committed offset (`committed_offset`).

    Both sides have one row per partition, so the join is tiny whatever the traffic.
    """
    return offsets.join(committed, ["topic", "partition"], "left").select(
        "topic",
        "partition",
        F.coalesce("committed_offset", "begin_offset").alias("committed_offset"),
        "end_offset",
        (F.col("end_offset") - F.coalesce("committed_offset", "begin_offset")).alias("lag"),
    )


def source_lag(source: Mapping) -> list[tuple[str, int, int, int, int]]:
    """(topic, partition, committed offset, end offset, lag) of one source in a stream's progress; none if its offsets
    are not by topic and partition."""

    def offsets(value) -> dict:
        value = json.loads(value) if isinstance(value, str) else value
        return value if isinstance(value, dict) else {}

    latest, done = offsets(source.get("latestOffset")), offsets(source.get("endOffset"))
    return [
        (topic, int(partition), at := int((done.get(topic) or {}).get(partition, 0)), int(end), int(end) - at)
        for topic, partitions in latest.items()
        if isinstance(partitions, dict)
        for partition, end in partitions.items()
    ]


def progress_lag(spark: SparkSession, progress: Mapping) -> DataFrame:
    """The lag a running Kafka query reports in `StreamingQuery.lastProgress`, one row per partition."""
    rows = [row for source in progress.get("sources", []) for row in source_lag(source)]
    return spark.createDataFrame(
        rows, "topic string, partition int, committed_offset bigint, end_offset bigint, lag bigint"
    )
