"""Quarantine that closes: which quarantined records have been resolved by a later run, and which are still open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.contracts import check_table_name
from tidelake.session import list_names

#: A record is known by its place in the log. Where a source gives no place, by a digest of its text.
RECORD_KEY = ("topic", "partition", "offset", "digest")
LEDGER_SCHEMA = "topic string, partition int, offset bigint, digest string"


def record_keys(rows: DataFrame) -> DataFrame:
    """The key of each bronze row as columns `_key_...`, none of them null: rows join on them by plain equality."""
    placed = F.col("_source_topic").isNotNull() & F.col("_partition").isNotNull() & F.col("_offset").isNotNull()
    text = F.coalesce("_raw_value", F.lit(""))
    return rows.withColumns(
        {
            "_key_topic": F.coalesce("_source_topic", F.lit("")),
            "_key_partition": F.coalesce("_partition", F.lit(-1)),
            "_key_offset": F.coalesce("_offset", F.lit(-1).cast("bigint")),
            "_key_digest": F.when(placed, F.lit("")).otherwise(F.sha2(text, 256)),
        }
    )


def _matched(invalid: DataFrame, resolved: DataFrame, how: str) -> DataFrame:
    keys = [f"_key_{c}" for c in RECORD_KEY]
    return record_keys(invalid).join(resolved.select(*RECORD_KEY).toDF(*keys), keys, how).select(*invalid.columns)


def open_rows(invalid: DataFrame, resolved: DataFrame) -> DataFrame:
    """Quarantined rows that no run has resolved: one anti join by the record's place. A repeated record goes with its first."""
    return _matched(invalid, resolved, "left_anti")


def resolved_rows(invalid: DataFrame, resolved: DataFrame) -> DataFrame:
    """Quarantined rows that a run has resolved; with `open_rows` they are all rows of the quarantine."""
    return _matched(invalid, resolved, "left_semi")


def quarantine_counts(valid: DataFrame, invalid: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row (n_valid, n_open, n_resolved, n_records): every stored record is one of the three. `resolved` are ledger rows."""
    known = resolved.select(*RECORD_KEY).distinct().toDF(*[f"_key_{c}" for c in RECORD_KEY]).withColumn("_known", F.lit(True))
    judged = record_keys(invalid).join(known, [f"_key_{c}" for c in RECORD_KEY], "left")
    state = judged.select(F.when(F.col("_known"), "resolved").otherwise("open").alias("state"))
    rows = valid.select(F.lit("valid").alias("state")).unionByName(state)
    return rows.agg(
        *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("valid", "open", "resolved")], F.count("*").alias("n_records")
    )


class Ledger:
    """The append-only list of resolved records, as Parquet below `<folder>/<table>/<run>`.

    A run writes its own folder and no other, so a run that is repeated replaces what it wrote and adds nothing. What it has
    listed is open to itself: a run that died between the merge and the ledger, or after it, finds the same rows again.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def read(self, spark: SparkSession, table: str, but_run: str | None = None) -> DataFrame:
        """The resolved records of a table, without those of one run."""
        base = f"{self.folder}/{check_table_name(table)}"
        # A run counts when its write is complete.
        runs = [r for r in list_names(spark, base) if r != _folder_name(but_run) and "_SUCCESS" in list_names(spark, f"{base}/{r}")]
        if not runs:
            return spark.createDataFrame([], LEDGER_SCHEMA)
        return spark.read.schema(LEDGER_SCHEMA).parquet(*[f"{base}/{r}" for r in runs])

    def resolve(self, rows: DataFrame, table: str, run: str) -> None:
        """List bronze rows as resolved by a run."""
        keys = record_keys(rows).select(*[F.col(f"_key_{c}").alias(c) for c in RECORD_KEY]).distinct()
        keys.write.mode("overwrite").parquet(f"{self.folder}/{check_table_name(table)}/{_folder_name(run)}")


def _folder_name(run: str | None) -> str | None:
    """A run's id as the name of a folder, different for different ids."""
    return None if run is None else "run-" + "".join(c if c.isascii() and (c.isalnum() or c == "-") else f"%{ord(c):x}." for c in run)
