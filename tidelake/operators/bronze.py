"""Bronze: every change record checked against its contract, raw text kept, split valid / invalid."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.contracts import BrokenContract, Contract
from tidelake.functions.envelope import MAP_IMAGE, event_time, is_tombstone, parse_records, table_of
from tidelake.functions.rules import RULES, error_column, with_rules

VALID_COLUMNS = (
    "_raw_value",
    "_source_topic",
    "_cdc_op",
    "_cdc_ts",
    "_ingested_at",
    "_partition",
    "_offset",
)
INVALID_COLUMNS = (
    "_raw_value",
    "_source_topic",
    "_ingested_at",
    "_validation_error",
    "_partition",
    "_offset",
)


def read_changes(df: DataFrame) -> DataFrame:
    """Topic and value as text, partition and offset where the source has them; other columns stay."""

    def optional(name: str, kind: str) -> Column:
        return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(f"_{name}")

    rest = [c for c in df.columns if c not in ("topic", "value", "partition", "offset")]
    return df.select(
        *rest,
        F.col("topic").cast("string").alias("_source_topic"),
        F.col("value").cast("string").alias("_raw_value"),
        optional("partition", "int"),
        optional("offset", "bigint"),
    )


def to_bronze(
    changes: DataFrame,
    contracts: Mapping[str, Contract | BrokenContract],
    on_missing_contract: str = "pass",
    ingested_at: Column | str | None = None,
) -> DataFrame:
    """One bronze row per change record, with `_table` and `_validation_error` ('' = valid).

    `ingested_at` is a column or a fixed time; the default is the time of the query.

    One JSON parse per record and no shuffle of the records while Spark broadcasts the rules, whatever the
    number of tables. Records of a table whose contract is broken are quarantined with the reason.
    """
    if isinstance(ingested_at, str):
        ingested_at = F.lit(ingested_at)
    stamp = F.current_timestamp() if ingested_at is None else ingested_at.cast("timestamp")
    rows = read_changes(changes).select(
        "_raw_value",
        "_source_topic",
        "_partition",
        "_offset",
        stamp.alias("_ingested_at"),
        table_of("_source_topic").alias("_table"),
    )
    parsed = parse_records(with_rules(rows, contracts), "_raw_value", MAP_IMAGE)
    verdict = error_column(
        F.col("_table"),
        F.col(RULES),
        F.col("_image"),
        F.col("_op"),
        F.col("_defect"),
        is_tombstone(F.col("_raw_value")),
        on_missing_contract,
    )
    return parsed.select(
        "_table",
        "_raw_value",
        "_source_topic",
        F.col("_op").alias("_cdc_op"),
        event_time(F.col("_ts_ms"), F.col("_ingested_at")).alias("_cdc_ts"),
        "_ingested_at",
        "_partition",
        "_offset",
        verdict.alias("_validation_error"),
    )


def is_valid() -> Column:
    return F.col("_validation_error") == ""


def valid_rows(bronze: DataFrame, table: str | None = None) -> DataFrame:
    """The `<table>_valid` rows of a bronze frame."""
    rows = bronze.filter(is_valid())
    return (rows if table is None else rows.filter(F.col("_table") == table)).select(*VALID_COLUMNS)


def invalid_rows(bronze: DataFrame, table: str | None = None) -> DataFrame:
    """The `<table>_invalid` rows of a bronze frame: quarantined, with the reason."""
    rows = bronze.filter(~is_valid())
    return (rows if table is None else rows.filter(F.col("_table") == table)).select(*INVALID_COLUMNS)


def day_slice(df: DataFrame, day: dt.date | str) -> DataFrame:
    """Rows ingested on a day: a half-open range on the plain column, so it reaches the scan."""
    start = dt.date.fromisoformat(day) if isinstance(day, str) else day
    end = start + dt.timedelta(days=1)
    column = F.col("_ingested_at")
    return df.filter((column >= F.lit(str(start)).cast("timestamp")) & (column < F.lit(str(end)).cast("timestamp")))


def routing_counts(bronze: DataFrame) -> DataFrame:
    """Rows per target table: `_table`, `_status` (valid / invalid), `n_rows`."""
    status = F.when(is_valid(), F.lit("valid")).otherwise(F.lit("invalid"))
    return bronze.groupBy("_table", status.alias("_status")).agg(F.count("*").alias("n_rows"))


def revalidate(
    invalid: DataFrame, contracts: Mapping[str, Contract], on_missing_contract: str = "pass"
) -> DataFrame:
    """Quarantined rows as bronze rows again, judged by the contracts of today.

    Operation and event time come from the raw text; the quarantine does not store them.
    """
    changes = invalid.select(
        F.col("_source_topic").alias("topic"),
        F.col("_raw_value").alias("value"),
        F.col("_partition").alias("partition"),
        F.col("_offset").alias("offset"),
        "_ingested_at",
    )
    return to_bronze(changes, contracts, on_missing_contract, ingested_at=F.col("_ingested_at"))
