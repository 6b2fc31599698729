"""What a running stream says about itself, kept as a table: a row for each trigger, source and partition."""

from __future__ import annotations

import json
import threading
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidelake.operators.report import source_lag

PROGRESS_SCHEMA = (
    "query_id string, run_id string, batch_id bigint, triggered_at string, source string, n_input_rows bigint, "
    "topic string, partition int, committed_offset bigint, end_offset bigint, lag bigint"
)


def progress_rows(progress: Mapping) -> list[tuple]:
    """The rows of one trigger. A source whose offsets are not by topic and partition has one row, without a lag."""
    trigger = (progress["id"], progress["runId"], int(progress["batchId"]), progress["timestamp"])
    return [
        (*trigger, source.get("description"), int(source.get("numInputRows") or 0), *place)
        for source in progress.get("sources", [])
        for place in source_lag(source) or [(None,) * 5]
    ]


class ProgressLog(StreamingQueryListener):
    """Appends the progress of the session's streams to a folder: `spark.streams.addListener(ProgressLog(spark, folder))`.

    A trigger has a folder of its own, named by the query, its run and the batch. Triggers that read nothing replace the row of
    the last batch. The rows are as many as the partitions that the trigger reports. `n_input_rows` is Spark's number of rows
    that the jobs of the trigger read: a sink that reads its batch in two jobs counts them twice. Offsets and lag are exact.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _end(self, run_id) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(str(run_id), threading.Event())

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._end(event.runId)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = json.loads(event.progress.json)
        rows = progress_rows(progress)
        if rows:
            name = f"{progress['id']}-{progress['runId']}-{progress['batchId']}"
            self.spark.createDataFrame(rows, PROGRESS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._end(event.runId).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> bool:
        """Wait until all progress of a query that has ended is written: events come in their order, a little later."""
        return self._end(query.runId).wait(seconds)

    def read(self) -> DataFrame:
        return self.spark.read.schema(PROGRESS_SCHEMA).parquet(f"{self.folder}/*")
