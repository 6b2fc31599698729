"""Layer storage: bronze files, versioned silver and gold tables, and row-level tables where a catalog has them."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.contracts import Contract, check_table_name
from tidelake.operators.bronze import INVALID_COLUMNS, VALID_COLUMNS, day_slice, is_valid
from tidelake.operators.report import COUNT_LOG_SCHEMA
from tidelake.operators.silver import META_COLUMNS, newer
from tidelake.session import delete_folder, file_system, list_names, read_text, rename, write_text

BRONZE_TYPES = {
    "_raw_value": T.StringType(),
    "_source_topic": T.StringType(),
    "_cdc_op": T.StringType(),
    "_cdc_ts": T.TimestampType(),
    "_ingested_at": T.TimestampType(),
    "_validation_error": T.StringType(),
    "_partition": T.IntegerType(),
    "_offset": T.LongType(),
}
#: Folders of a day, which Spark's readers pass over: the batches of each fold, and what is hidden while one is put in place.
_FOLDS, _OPEN = ".folds", ".open"
_V1_SOURCES = "spark.sql.sources.useV1SourceList"
#: The columns that the folders of bronze files carry.
FOLDERS = ("_ingest_date", "_stream_id", "_batch_id", "_status", "_table")
_STATUS_COLUMNS = {"valid": VALID_COLUMNS, "invalid": INVALID_COLUMNS}


def split_name(name: str) -> tuple[str, str]:
    """`database.table`, both checked, since they end up in DDL."""
    database, table = name.split(".")
    return check_table_name(database), check_table_name(table)


def batch_day(batch: DataFrame) -> str | None:
    """The ingestion day of a micro-batch, from its first row; None if it is empty."""
    first = batch.select(F.date_format("_ingested_at", "yyyy-MM-dd")).first()
    return None if first is None else first[0]


def write_counts(spark: SparkSession, folder: str, run_id: str, counts: Sequence[tuple[str, str, int]]) -> None:
    """Put a run's (table, counter, number) rows into the count log. A run has its own folder, which a repeated run replaces."""
    name = re.sub(r"[^A-Za-z0-9-]", lambda c: f"%{ord(c[0]):x}.", run_id)
    rows = spark.createDataFrame([(run_id, *c) for c in counts], COUNT_LOG_SCHEMA)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/run-{name}")


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The count log: run_id, table_name, counter, n."""
    return spark.read.schema(COUNT_LOG_SCHEMA).parquet(f"{folder}/run-*")


class BronzeFiles:
    """The bronze pairs of all tables as Parquet below one folder.

    Layout: `_ingest_date=<day>/_stream_id=<id>/_batch_id=<n>/_status=<valid|invalid>/_table=<t>/`. The id
    is the one Spark keeps in the stream's checkpoint, so batches of another stream, or of a new
    checkpoint, never meet. A micro-batch is one job that overwrites its own folder, whatever the number of
    tables, so a repeated batch replaces itself, also when the contracts changed in between and records
    moved between valid and invalid. A pair exists as soon as a record of its topic does; before that it
    reads as empty.
    """

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")

    def _day(self, day: str) -> str:
        return f"{self.root}/_ingest_date={day}"

    def write(
        self, bronze: DataFrame, batch_id: int, stream_id: str = "batch", day: str | None = None
    ) -> dict[str, int] | None:
        """Append one micro-batch. All its rows carry the same ingestion instant; empty is a no-op.

        Returns the numbers of valid and invalid rows, counted by the write itself; None if nothing was to be written. `day`, where the caller knows it, saves a look at the parsed rows. A batch that `compact_day` folds or has
        folded is not written once more.
        """
        day = day or batch_day(bronze)
        if day is None or f"{stream_id}/{batch_id}" in self._folded(bronze.sparkSession, day):
            return None
        same_day = F.date_format("_ingested_at", "yyyy-MM-dd") == day
        stamp = F.when(same_day, F.col("_ingested_at")).otherwise(
            F.raise_error(F.lit("a bronze batch must have one ingestion time"))
        )
        rows = bronze.withColumn("_ingested_at", stamp).withColumn(
            "_status", F.when(is_valid(), "valid").otherwise("invalid")
        )
        counted = Observation()
        counts = {f"n_{s}": F.count_if(F.col("_status") == s) for s in ("valid", "invalid")}
        rows = rows.observe(counted, *[c.alias(name) for name, c in counts.items()])
        # Every file has the same columns in the same order: Spark finds a footer's statistics by position.
        rows = rows.select(*BRONZE_TYPES, "_status", "_table")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
            "_status", "_table"
        ).parquet(self._batch(day, f"{stream_id}/{batch_id}"))
        if f"{stream_id}/{batch_id}" in self._folded(bronze.sparkSession, day):  # planned meanwhile: its rows are in the fold
            delete_folder(bronze.sparkSession, self._batch(day, f"{stream_id}/{batch_id}"))
        return counted.get

    def _folded(self, spark: SparkSession, day: str) -> set[str]:
        """The batches of a day that are part of a compacted one, or are being folded."""
        return {batch for name in list_names(spark, f"{self._day(day)}/{_FOLDS}") for batch in self._planned(spark, day, name)}

    def _planned(self, spark: SparkSession, day: str, name: str) -> dict[str, str]:
        """The batches of a fold, each with the time at which it was complete."""
        lines = read_text(spark, f"{self._day(day)}/{_FOLDS}/{name}").splitlines()
        return dict(line.split("\t") for line in lines)

    def _hidden(self, spark: SparkSession, day: str | None) -> dict[str, list[str]]:
        """By day, the batches that readers pass over, while a fold takes their place or is put there."""
        found: dict[str, dict[str, str]] = {}
        system, pattern = file_system(spark, f"{self._day(day or '*')}/{_OPEN}/*")
        for status in system.globStatus(pattern) or []:
            path = status.getPath()
            found.setdefault(path.getParent().getParent().getName().removeprefix("_ingest_date="), {})[path.getName()] = path.toString()
        return {d: read_text(spark, marks[max(marks)]).splitlines() for d, marks in found.items()}

    def compact_day(self, spark: SparkSession, day: str, rows_per_file: int = 1_000_000) -> int:
        """Fold the batches of a closed day into few files per table; returns the number of batches folded.

        Batches may arrive and repeat meanwhile: only those that the fold has planned, and read complete, are taken away,
        and the stream does not write a planned one again. Readers see each row once at any time; what they pass over
        is switched by one rename. A run that dies at any point is finished, or undone, by the next one. A hot table is
        spread over as many tasks as its size asks for. One run at a time folds a day.
        """
        for _ in self.fold_steps(spark, day, rows_per_file):
            pass
        return len(self._folded(spark, day))

    def fold_steps(self, spark: SparkSession, day: str, rows_per_file: int = 1_000_000) -> Iterator[str]:
        """`compact_day` step by step: gives the name of each step when it is done."""
        folder = self._day(day)
        self._recover(spark, day)
        yield "recovered"
        batches = self._complete(spark, day)
        if not batches:
            return
        numbers = [int(name.split(".")[0]) for name in list_names(spark, f"{folder}/{_FOLDS}")]
        number = max(numbers, default=-1) + 1
        plan, aside = f"{folder}/{_FOLDS}/{number}.plan", f"{folder}/.rows-{number}"
        write_text(spark, plan, "\n".join(f"{batch}\t{at}" for batch, at in batches.items()))
        yield "planned"
        paths = [self._batch(day, batch) for batch in batches]
        rows = spark.read.schema(self._schema()).option("basePath", self.root).parquet(*paths)
        rows = rows.drop("_ingest_date", "_stream_id", "_batch_id").hint("rebalance", "_status", "_table")
        writer = rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
        writer.partitionBy("_status", "_table").parquet(aside)
        yield "written"
        if not batches.items() <= self._complete(spark, day).items():
            self._undo(spark, day, number)  # a batch was written again before it was planned: its rows may not be those read
            raise RuntimeError(f"{folder}: a batch has changed while it was folded; run again")
        write_text(spark, f"{folder}/{_OPEN}/1", f"compacted/{number}")
        yield "announced"
        rename(spark, aside, self._batch(day, f"compacted/{number}"))
        yield "placed"
        write_text(spark, f"{folder}/{_OPEN}/2", "\n".join(batches))
        yield "switched"
        self._clean(spark, day, number)
        yield "cleaned"

    def _batch(self, day: str, batch: str) -> str:
        stream, number = batch.rsplit("/", 1)
        return f"{self._day(day)}/_stream_id={stream}/_batch_id={number}"

    def _complete(self, spark: SparkSession, day: str) -> dict[str, str]:
        """The complete batches of a day, each with the time of its mark."""
        system, pattern = file_system(spark, f"{self._day(day)}/_stream_id=*/_batch_id=*/_SUCCESS")
        found = {}
        for status in system.globStatus(pattern) or []:
            batch = status.getPath().getParent()
            name = "/".join(part.getName().split("=", 1)[1] for part in (batch.getParent(), batch))
            found[name] = str(status.getModificationTime())
        return found

    def _clean(self, spark: SparkSession, day: str, number: int) -> None:
        """Take away the batches of a fold that has been switched to, and nothing else."""
        plan = f"{number}.plan"
        for batch in self._planned(spark, day, plan):
            delete_folder(spark, self._batch(day, batch))
        delete_folder(spark, f"{self._day(day)}/{_OPEN}")
        rename(spark, f"{self._day(day)}/{_FOLDS}/{plan}", f"{self._day(day)}/{_FOLDS}/{number}.folded")

    def _undo(self, spark: SparkSession, day: str, number: int) -> None:
        """As if a fold had never been planned; its batches are all there."""
        delete_folder(spark, self._batch(day, f"compacted/{number}"))
        for left in (f".rows-{number}", _OPEN, f"{_FOLDS}/{number}.plan"):
            delete_folder(spark, f"{self._day(day)}/{left}")

    def _recover(self, spark: SparkSession, day: str) -> None:
        """Finish a fold that readers have been switched to, undo one that they have not."""
        for name in list_names(spark, f"{self._day(day)}/{_FOLDS}"):
            if name.endswith(".plan"):
                number = int(name.split(".")[0])
                step = self._clean if "2" in list_names(spark, f"{self._day(day)}/{_OPEN}") else self._undo
                step(spark, day, number)

    @staticmethod
    def _schema() -> T.StructType:
        return T.StructType(
            [T.StructField(n, t) for n, t in BRONZE_TYPES.items()]
            + [
                T.StructField("_ingest_date", T.DateType()),
                T.StructField("_stream_id", T.StringType()),
                T.StructField("_batch_id", T.LongType()),
                T.StructField("_status", T.StringType()),
                T.StructField("_table", T.StringType()),
            ]
        )

    def read(self, spark: SparkSession, table: str = "*", status: str = "valid", day: str | None = None) -> DataFrame:
        """`<table>_valid` or `<table>_invalid`, or of all tables; a `day` lists that day's folder only.

        Spark lists the folders, on the executors where there are many, and prunes by status and table.
        """
        columns = ["_table", *_STATUS_COLUMNS[status]] if table == "*" else list(_STATUS_COLUMNS[status])
        frame = self._stored_rows(spark, day).filter(F.col("_status") == status)
        if table != "*":
            frame = frame.filter(F.col("_table") == table)
        frame = frame.select(*columns)
        return frame if day is None else day_slice(frame, day)

    def _stored_rows(self, spark: SparkSession, day: str | None) -> DataFrame:
        """What the batches hold, with the columns of their folders and without what a fold hides."""
        schema = self._schema()
        try:
            frame = spark.read.schema(schema).option("basePath", self.root).parquet(self.root if day is None else self._day(day))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            frame = spark.createDataFrame([], schema)
        for hidden_day, batches in self._hidden(spark, day).items():
            hidden = F.concat_ws("/", "_stream_id", F.col("_batch_id").cast("string")).isin(batches)
            frame = frame.filter(~((F.col("_ingest_date") == F.lit(hidden_day).cast("date")) & hidden))
        return frame

    def _footers(self, spark: SparkSession, day: str | None, *measures: Column) -> DataFrame:
        """Counts, minima and maxima by batch, status and table, taken from the files' footers: no column is read.

        Spark pushes such aggregates into the scan of its V2 reader where they are grouped by all folders, and finds a column by
        its position: files need the order that `write` and `compact_day` give them. Partition and offset are the only
        columns of their types, so in other files the scan fails; it cannot take another column's values. What a fold hides
        is dropped by folder, after the aggregate.
        """
        spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")  # the V1 reader, of all other reads, does not look at it
        path = self.root if day is None else self._day(day)
        if not file_system(spark, path)[0].exists(file_system(spark, path)[1]):
            return spark.createDataFrame([], self._schema()).groupBy(*FOLDERS).agg(*measures)
        v1_sources = spark.conf.get(_V1_SOURCES)
        spark.conf.set(_V1_SOURCES, ",".join(name for name in v1_sources.split(",") if name != "parquet"))
        try:  # the reader is chosen here, for this frame only
            frame = spark.read.schema(self._schema()).option("basePath", self.root).parquet(path)
        finally:
            spark.conf.set(_V1_SOURCES, v1_sources)
        folders = frame.groupBy(*FOLDERS).agg(*measures)
        for hidden_day, batches in self._hidden(spark, day).items():
            hidden = F.concat_ws("/", "_stream_id", F.col("_batch_id").cast("string")).isin(batches)
            folders = folders.filter(~((F.col("_ingest_date") == F.lit(hidden_day).cast("date")) & hidden))
        return folders

    def counts(self, spark: SparkSession, day: str | None = None) -> DataFrame:
        """(table_name, status, n_rows) of all pairs, or of those of one day's folder, from the footers alone."""
        folders = self._footers(spark, day, F.count("*").alias("n"))
        return folders.groupBy(F.col("_table").alias("table_name"), F.col("_status").alias("status")).agg(F.sum("n").alias("n_rows"))

    def offsets(self, spark: SparkSession, day: str | None = None) -> DataFrame:
        """(table_name, partition, begin_offset, end_offset, n_records) of valid and invalid rows together.

        A batch whose footers show one partition of its topic has its offsets there too. Only the batches in which several
        partitions lie together are read, two columns of them. Where any partition or offset is null, those columns are
        read of all batches; null partitions are a group of their own, as are those without any offset (null ends).
        """
        filled = [F.count(c).alias(f"n{c}") for c in ("_partition", "_offset")]
        missing = self._footers(spark, day, F.count("*").alias("n"), *filled)
        missing = missing.agg(F.bool_or((F.col("n") != F.col("n_partition")) | (F.col("n") != F.col("n_offset")))).first()[0]  # one row
        rows = self._stored_rows(spark, day).select(*FOLDERS, "_partition", "_offset")
        ends = [F.min("_offset").alias("first"), F.max("_offset").alias("last"), F.count("*").alias("n")]
        if missing:
            parts = rows.groupBy("_table", "_partition").agg(*ends)
        else:
            of_partition = [F.min("_partition").alias("low"), F.max("_partition").alias("high")]
            folders = self._footers(spark, day, *of_partition, *ends)
            single = folders.where(F.col("low") == F.col("high")).select("_table", F.col("low").alias("_partition"), "first", "last", "n")
            mixed = folders.where(F.col("low") != F.col("high")).select(*FOLDERS)
            read = rows.join(mixed, list(FOLDERS), "left_semi").groupBy("_table", "_partition").agg(*ends)
            parts = single.unionByName(read)
        return parts.groupBy(F.col("_table").alias("table_name"), F.col("_partition").alias("partition")).agg(
            F.min("first").alias("begin_offset"), (F.max("last") + 1).alias("end_offset"), F.sum("n").alias("n_records")
        )


def bronze_ddl(name: str, status: str, provider: str = "parquet") -> str:
    """DDL of one table of a bronze pair, partitioned by ingestion day.

    Iceberg takes the `days` transform. Parquet tables know no transforms and get a date column; they
    also get the stream's and the batch's id as partitions, so that a repeated batch can be replaced.
    """
    database, table = split_name(name)
    columns = ", ".join(f"`{c}` {BRONZE_TYPES[c].simpleString()}" for c in _STATUS_COLUMNS[status])
    if provider == "iceberg":
        return (
            f"CREATE TABLE IF NOT EXISTS {database}.{table}_{status} ({columns}, `_stream_id` string, `_batch_id` bigint) "
            f"USING iceberg PARTITIONED BY (days(_ingested_at))"
        )
    return (
        f"CREATE TABLE IF NOT EXISTS {database}.{table}_{status} "
        f"({columns}, `_ingest_date` date, `_stream_id` string, `_batch_id` bigint) "
        f"USING {provider} PARTITIONED BY (`_ingest_date`, `_stream_id`, `_batch_id`)"
    )


def catalog_name(table: str) -> str:
    """A name any catalog takes, for tables of topics that have other characters: each becomes its code."""
    return re.sub(r"[^A-Za-z0-9_]", lambda m: f"_x{ord(m[0]):x}_", table)


class BronzeTables:
    """The bronze pairs as catalog tables, created when a topic is first seen.

    Two writes per table and batch, so the frame is persisted for the batch. Only table names reach the
    driver. Prefer `BronzeFiles` for many tables without a table format.
    """

    def __init__(self, database: str, provider: str = "parquet") -> None:
        self.database = check_table_name(database)
        self.provider = provider
        self._created: set[str] = set()

    def create(self, spark: SparkSession, table: str) -> None:
        if table in self._created:
            return
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}")
        for status in _STATUS_COLUMNS:
            spark.sql(bronze_ddl(f"{self.database}.{catalog_name(table)}", status, self.provider))
        self._created.add(table)

    def write(self, bronze: DataFrame, batch_id: int, stream_id: str = "batch", day: str | None = None) -> None:
        """Append one micro-batch, to the pair of each table; `day` is not needed here."""
        spark = bronze.sparkSession
        rows = bronze.persist()
        try:
            tables = [r["_table"] for r in rows.select("_table").distinct().collect()]
            for table in sorted(tables):
                self.create(spark, table)
                for status, columns in _STATUS_COLUMNS.items():
                    part = rows.filter((F.col("_table") == table) & (is_valid() if status == "valid" else ~is_valid()))
                    self._append(part.select(*columns), f"{self.database}.{catalog_name(table)}_{status}", batch_id, stream_id)
        finally:
            rows.unpersist()

    def _append(self, part: DataFrame, name: str, batch_id: int, stream_id: str) -> None:
        rows = part.withColumn("_stream_id", F.lit(stream_id)).withColumn("_batch_id", F.lit(batch_id).cast("bigint"))
        if self.provider == "iceberg":  # not run here: needs a catalog with row-level operations
            rows.writeTo(name).overwrite((F.col("_stream_id") == stream_id) & (F.col("_batch_id") == batch_id))
            return
        # Drop what an earlier attempt of this stream's batch wrote, then append: a crash in between only
        # means that the batch, not yet committed by the stream, is attempted once more.
        spark = part.sparkSession
        found = spark.sql(f"SHOW PARTITIONS {name} PARTITION (_stream_id='{stream_id}', _batch_id={batch_id})")
        for row in found.collect():  # a row per day of one batch
            spec = ", ".join("{}='{}'".format(*p.split("=", 1)) for p in row[0].split("/"))
            spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({spec})")
        columns = [c for c in rows.columns if not c.endswith("_id")]
        rows = rows.select(*columns, F.to_date("_ingested_at").alias("_ingest_date"), "_stream_id", "_batch_id")
        rows.write.mode("append").insertInto(name)

    def read(self, spark: SparkSession, table: str, status: str = "valid", day: str | None = None) -> DataFrame:
        name = f"{self.database}.{catalog_name(table)}_{status}"
        columns = list(_STATUS_COLUMNS[status])
        if not spark.catalog.tableExists(name):
            return spark.createDataFrame([], T.StructType([T.StructField(c, BRONZE_TYPES[c]) for c in columns]))
        spark.catalog.refreshTable(name)  # the stream writes in a session of its own
        frame = spark.table(name)
        if day is not None:
            if "_ingest_date" in frame.columns:
                frame = frame.filter(F.col("_ingest_date") == F.lit(day).cast("date"))
            frame = day_slice(frame, day)
        return frame.select(*columns)


class SchemaChanged(ValueError):
    """A published table would change its columns."""


#: Types that hold every value of another.
_WIDER = {"smallint": ("int", "bigint", "double"), "int": ("bigint", "double"), "float": ("double",)}


def grown_schema(stored: T.StructType, incoming: T.StructType) -> T.StructType:
    """The columns of a stored table after rows of a contract that has changed: stored ones first, then added ones, then metadata.

    A type becomes the wider of the two if that holds every value; columns that the contract has dropped stay. Anything
    else is refused.
    """
    types = {f.name: f.dataType for f in incoming.fields}
    fields, refused = [], []
    for field in stored.fields:
        old, new = field.dataType, types.pop(field.name, field.dataType)
        if old != new and new.simpleString() in _WIDER.get(old.simpleString(), ()):
            old = new
        if old != new and old.simpleString() not in _WIDER.get(new.simpleString(), ()):
            refused.append(f"{field.name}: {old.simpleString()} cannot become {new.simpleString()}")
        fields.append(T.StructField(field.name, old))
    if refused:
        raise SchemaChanged("; ".join(refused))
    added = [T.StructField(f.name, f.dataType) for f in incoming.fields if f.name in types]
    ends = [f for f in fields if f.name in META_COLUMNS]
    return T.StructType([*(f for f in fields if f.name not in META_COLUMNS), *added, *ends])


def in_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame in the columns of a grown schema; those it does not have are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def _versions(spark: SparkSession, database: str, table: str) -> list[int]:
    pattern = re.compile(rf"{re.escape(table)}__v(\d+)", re.IGNORECASE)
    names = [t.name for t in spark.catalog.listTables(database, f"{table}__v*")]
    return sorted(int(m.group(1)) for n in names if (m := pattern.fullmatch(n)))


def _columns(schema: T.StructType) -> list[tuple[str, T.DataType]]:
    return [(f.name, f.dataType) for f in schema.fields]


def write_version(
    spark: SparkSession,
    df: DataFrame,
    name: str,
    keys: Sequence[str] = (),
    buckets: int | None = None,
    aligned: bool = False,
    grows: bool = False,
) -> int:
    """Write a frame as the next, not yet visible version of a table; fails if the columns change, unless it `grows`.

    With `buckets` the version is bucketed by its keys, so the next merge on these keys reads it without
    shuffling it. `aligned` says that the rows already lie in tasks by bucket, as they do after a merge
    into a bucketed table; otherwise they are shuffled once, so that each bucket becomes one file.
    """
    database, table = split_name(name)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    if not grows and spark.catalog.tableExists(name) and _columns(spark.table(name).schema) != _columns(df.schema):
        raise SchemaChanged(f"{name}: columns differ from the published table")
    version = max(_versions(spark, database, table), default=0) + 1
    if buckets and keys:
        rows = df if aligned else df.repartition(buckets, *keys)
        writer = rows.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    else:
        writer = df.write.format("parquet")
    writer.saveAsTable(f"{database}.{table}__v{version}")
    return version


def publish_version(spark: SparkSession, name: str, version: int, keep: int = 2, keep_hours: float = 0.0) -> None:
    """Point the table's name at a version, in one catalog change, and drop versions no reader uses.

    The last `keep` versions stay, and all that are younger than `keep_hours`: a query that started on an
    older one must end within that time.

    Spark cannot overwrite a table it is reading from; a merge therefore writes the next version and
    switches. A crash before the switch leaves the published version as it was.
    """
    database, table = split_name(name)
    spark.sql(f"CREATE OR REPLACE VIEW {database}.{table} AS SELECT * FROM {database}.{table}__v{version}")
    for old in _versions(spark, database, table):
        if old <= version - keep and _age_hours(spark, f"{database}.{table}__v{old}") >= keep_hours:
            spark.sql(f"DROP TABLE IF EXISTS {database}.{table}__v{old}")


def _age_hours(spark: SparkSession, name: str) -> float:
    files = spark.table(name).select(F.max("_metadata.file_modification_time").alias("at"))
    age = files.select((F.unix_seconds(F.current_timestamp()) - F.unix_seconds("at")) / 3600).first()[0]
    return float("inf") if age is None else age


def read_version(spark: SparkSession, name: str, version: int) -> DataFrame:
    return spark.table(f"{name}__v{version}")


def create_silver(
    spark: SparkSession, name: str, contract: Contract, timestamps: str = "long", buckets: int | None = None
) -> None:
    """The empty silver table of a contract: its fields and the metadata columns; no-op if it exists."""
    if spark.catalog.tableExists(name):
        return
    schema = silver_schema(contract, timestamps)
    empty = spark.createDataFrame([], schema)
    publish_version(spark, name, write_version(spark, empty, name, contract.require_keys(), buckets))


def silver_schema(contract: Contract, timestamps: str = "long") -> T.StructType:
    """Contract fields, then `_cdc_op`, `_cdc_ts`, `_ingested_at` and the log position; all nullable."""
    fields = []
    for declared, field in zip(contract.fields, contract.to_struct().fields):
        as_timestamp = declared.type == "timestamp" and timestamps == "timestamp"
        fields.append(T.StructField(field.name, T.TimestampType() if as_timestamp else field.dataType))
    types = {**BRONZE_TYPES, "_lsn": T.LongType()}
    meta = [T.StructField(c, types[c]) for c in META_COLUMNS]
    return T.StructType(fields + meta)


def silver_ddl(name: str, contract: Contract, timestamps: str = "long", provider: str = "iceberg") -> str:
    """DDL of a silver table on a catalog with row-level operations, merged on read."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in silver_schema(contract, timestamps))
    return (
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {provider} "
        "TBLPROPERTIES ('write.merge.mode'='merge-on-read')"
    )


def merge_into_table(
    source: DataFrame, name: str, keys: Sequence[str], guard: bool = True, tombstones: bool = False
) -> None:
    """The merge as one statement, for catalogs with row-level operations (for example Iceberg).

    Not run here: this needs such a catalog. It rewrites only what the batch touches, which makes it
    the form to use for very large silver tables.
    """
    target = name.split(".")[-1]
    same = F.lit(True)
    for key in keys:
        same = same & (F.col(f"{target}.{key}") == F.col(f"_changes.{key}"))
    wins = newer("_changes", target, source.columns, keys) if guard else F.lit(True)
    deleted = F.col("_changes._cdc_op") == "d"
    merge = source.alias("_changes").mergeInto(name, same)
    if tombstones:
        merge.whenMatched(wins).updateAll().whenNotMatched().insertAll().merge()
        return
    (
        merge.whenMatched(wins & deleted)
        .delete()
        .whenMatched(wins & ~deleted)
        .updateAll()
        .whenNotMatched(~deleted)
        .insertAll()
        .merge()
    )
