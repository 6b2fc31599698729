"""Change records from Kafka, as a stream or as a bounded read.

The Kafka connector is a Spark package (`org.apache.spark:spark-sql-kafka-0-10`) that must be on the
cluster's class path. Everything downstream takes any frame with `topic` and `value`.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOPIC_PATTERN = r"cdc\.public\..*"


def stream_options(
    servers: str,
    pattern: str = TOPIC_PATTERN,
    starting_offsets: str = "earliest",
    max_offsets_per_trigger: int | None = None,
    min_partitions: int | None = None,
) -> dict[str, str]:
    """Reader options. `min_partitions` splits a topic partition that holds most of a batch."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribePattern": pattern,
        "startingOffsets": starting_offsets,
        "failOnDataLoss": "false",
    }
    if max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    return options


def read_stream(spark: SparkSession, servers: str, **options) -> DataFrame:
    """All change topics as a streaming frame."""
    reader = spark.readStream.format("kafka").options(**stream_options(servers, **options))
    return reader.load().select(
        F.col("topic").cast("string"),
        F.col("value").cast("string"),
        "partition",
        "offset",
        "timestamp",
    )


def bounded_options(servers: str, topic: str, partition: int, offset: int) -> dict[str, str]:
    """Options for one partition from an offset. -1 is the connector's mark for the end of the log."""
    return {
        "kafka.bootstrap.servers": servers,
        "assign": json.dumps({topic: [partition]}),
        "startingOffsets": json.dumps({topic: {str(partition): offset}}),
        "endingOffsets": json.dumps({topic: {str(partition): -1}}),
        "failOnDataLoss": "false",
    }


def read_bounded(
    spark: SparkSession, servers: str, topic: str, partition: int, offset: int, max_records: int
) -> DataFrame:
    """At most `max_records` records of one partition, from an offset on.

    One topic partition is read by one task in offset order, so the limit stops the read early.
    """
    options = bounded_options(servers, topic, partition, offset)
    return spark.read.format("kafka").options(**options).load().limit(max_records).orderBy("offset")


def bounded_slice(changes: DataFrame, topic: str, partition: int, offset: int, max_records: int) -> DataFrame:
    """The same slice of any frame of change records, in offset order."""
    rows = changes.filter(
        (F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") >= offset)
    )
    return rows.orderBy("offset").limit(max_records)


def has_records(changes: DataFrame, topic: str) -> bool:
    """Liveness: whether the topic holds at least one record."""
    return not changes.filter(F.col("topic") == topic).isEmpty()
