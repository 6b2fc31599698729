"""Silver tables in key buckets: a merge rewrites the buckets that its batch touches, and no others."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.operators.silver import merge_small_batch
from tidelake.session import delete_folder, file_system, list_names
from tidelake.sources.lake import SchemaChanged, grown_schema, in_columns, split_name

BUCKET = "_bucket"
#: Partitions that one statement adds, and statements and file system calls that run at once.
_PER_STATEMENT, _AT_ONCE = 500, 16


class KeyedTable:
    """A Parquet table partitioned by a bucket of its key; each partition's place in the catalog says which files count.

    Buckets are hashes of the key, `buckets` of them, or with `width` ranges of a single whole-number key: new keys then
    touch the last few buckets only. A merge reads the buckets of its batch, writes them anew beside the stored ones, and
    switches them a few at a time: a reader sees each bucket before or after the merge. A run that dies between
    two switches leaves whole buckets, and running it once more completes it, since merging a change twice is
    merging it once. What a bucket had before its last merge stays for readers, older files go after `keep_hours`.
    """

    def __init__(self, name: str, keys: Sequence[str], buckets: int = 64, width: int | None = None, keep_hours: float = 1.0) -> None:
        if width is not None and len(keys) != 1:
            raise ValueError("ranges need a single key")
        split_name(name)
        self.name, self.keys, self.buckets, self.width, self.keep_hours = name, list(keys), buckets, width, keep_hours

    def bucket(self) -> Column:
        if self.width is not None:
            return F.floor(F.col(self.keys[0]) / self.width).cast("long")
        # Of the key as text, so that a key may become a wider type.
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets))

    def create(self, spark: SparkSession, schema: T.StructType) -> None:
        """The empty table; no-op if it exists."""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {split_name(self.name)[0]}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, `{BUCKET}` bigint) USING parquet PARTITIONED BY (`{BUCKET}`)")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name).drop(BUCKET)

    def grow(self, spark: SparkSession, incoming: T.StructType) -> T.StructType:
        """Add the columns that a batch has and the table has not. Stored files stay, so no type may change."""
        stored = self.read(spark).schema
        grown = grown_schema(stored, incoming)
        kinds = {f.name: f.dataType for f in grown.fields}
        changed = [f.name for f in stored.fields if kinds[f.name] != f.dataType]
        if changed:
            raise SchemaChanged(f"{self.name}: {', '.join(changed)} would change its type")
        added = [f"`{f.name}` {f.dataType.simpleString()}" for f in grown.fields if f.name not in stored.names]
        if added:
            spark.sql(f"ALTER TABLE {self.name} ADD COLUMNS ({', '.join(added)})")
        return self.read(spark).schema

    def merge(self, batch: DataFrame, guard: bool = True, tombstones: bool = False) -> list[int]:
        """Merge deduplicated changes, a written table; returns the buckets that were read and written."""
        spark = batch.sparkSession
        schema = self.grow(spark, batch.schema)
        batch = in_columns(batch, schema)
        touched = sorted(r[0] for r in batch.select(self.bucket().alias(BUCKET)).distinct().collect())  # no more than buckets
        if not touched:
            return []
        stored = spark.table(self.name)
        if not self._known(spark) <= set(touched):  # a list of every bucket would prune nothing
            stored = stored.where(F.col(BUCKET).isin(touched))
        merged = merge_small_batch(stored.drop(BUCKET), batch, self.keys, guard, tombstones).withColumn(BUCKET, self.bucket())
        root = self._root(spark)
        runs = [int(n.removeprefix("run-")) for n in list_names(spark, root) if n.startswith("run-")]
        run = f"{root}/run-{max(runs, default=0) + 1}"
        # Tasks put their files in place themselves: no reader looks into the folder of a run before the switch.
        writer = merged.hint("rebalance", BUCKET).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        writer.partitionBy(BUCKET).parquet(run)
        self._switch(spark, run, touched)
        self._forget(spark, touched)
        return touched

    def _root(self, spark: SparkSession) -> str:
        """The table's own folder: what runs write lies below it."""
        found = spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").where("col_name = 'Location'").first()
        return found["data_type"].rstrip("/")

    def _known(self, spark: SparkSession) -> set[int]:
        """The buckets that the catalog has."""
        return {int(r[0].split("=")[1]) for r in spark.sql(f"SHOW PARTITIONS {self.name}").collect()}

    def _places(self, spark: SparkSession, run: str) -> set[tuple[int, int]]:
        """(run, bucket) of each folder below a run, or a pattern of runs; the names come in one call, as one text."""
        system, pattern = file_system(spark, f"{run}/{BUCKET}=*")
        paths = spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(system.globStatus(pattern))
        names = spark._jvm.org.apache.commons.lang3.ArrayUtils.toString(paths)
        return {(int(r), int(b)) for r, b in re.findall(rf"/run-(\d+)/{BUCKET}=(-?\d+)(?=[,}}])", names)}

    def _switch(self, spark: SparkSession, run: str, touched: Sequence[int]) -> None:
        known = self._known(spark)
        place = lambda bucket: f"{run}/{BUCKET}={bucket}"

        def make(bucket: int) -> None:
            system, folder = file_system(spark, place(bucket))
            system.mkdirs(folder)

        def move(bucket: int) -> None:
            spark.sql(f"ALTER TABLE {self.name} PARTITION ({BUCKET}={bucket}) SET LOCATION '{place(bucket)}'")

        written = {bucket for _, bucket in self._places(spark, run)}
        _at_once(make, [b for b in touched if b not in written])  # buckets that have lost all their rows
        added = [b for b in touched if b not in known]
        for start in range(0, len(added), _PER_STATEMENT):
            places = " ".join(f"PARTITION ({BUCKET}={b}) LOCATION '{place(b)}'" for b in added[start : start + _PER_STATEMENT])
            spark.sql(f"ALTER TABLE {self.name} ADD IF NOT EXISTS {places}")
        _at_once(move, [b for b in touched if b in known])
        spark.catalog.refreshTable(self.name)

    def _forget(self, spark: SparkSession, touched: Sequence[int]) -> None:
        """Remove what buckets had two merges ago and earlier, if it is old enough for no query to read it any more."""
        root, wanted, found = self._root(spark), set(touched), {}
        for run, bucket in self._places(spark, f"{root}/run-*"):
            if bucket in wanted:
                found.setdefault(bucket, []).append(run)
        now = spark._jvm.System.currentTimeMillis()

        def remove(place: str) -> None:
            system, folder = file_system(spark, place)
            if now - system.getFileStatus(folder).getModificationTime() >= self.keep_hours * 3_600_000:
                delete_folder(spark, place)

        _at_once(remove, [f"{root}/run-{run}/{BUCKET}={b}" for b, runs in found.items() for run in sorted(runs)[:-2]])


def _at_once(call: Callable, items: Iterable) -> None:
    """A call for each item, a few at a time; the first error is raised."""
    with ThreadPoolExecutor(max_workers=_AT_ONCE) as pool:
        for _ in pool.map(call, items):
            pass
