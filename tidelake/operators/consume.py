"""The queries users run on the layers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.envelope import json_field


def op_counts(bronze: DataFrame) -> DataFrame:
    """Records per operation."""
    return bronze.groupBy("_cdc_op").agg(F.count("*").alias("total"))


def distinct_ops(bronze: DataFrame, limit: int | None = None) -> DataFrame:
    """All operations; with `limit`, the first so many."""
    ops = bronze.select("_cdc_op").distinct().orderBy("_cdc_op")
    return ops if limit is None else ops.limit(limit)


def latest_changes(bronze: DataFrame, path: str, name: str, limit: int = 10, *ties: Column) -> DataFrame:
    """The most recently ingested records with one JSON field; the field is read for those rows only."""
    rows = bronze.orderBy(F.col("_ingested_at").desc(), *ties).limit(limit)
    return rows.select("_source_topic", "_cdc_op", "_ingested_at", json_field("_raw_value", path).alias(name))


def json_field_lookup(bronze: DataFrame, path: str, value: str) -> DataFrame:
    """Records whose JSON field has a value."""
    return bronze.filter(json_field("_raw_value", path) == value)


def latency(bronze: DataFrame) -> DataFrame:
    """Adds `latency_us`, the microseconds between the change and its ingestion."""
    micros = F.unix_micros("_ingested_at") - F.unix_micros("_cdc_ts")
    return bronze.withColumn("latency_us", micros)


def status_counts(orders: DataFrame) -> DataFrame:
    """Silver orders per status, most frequent first."""
    return orders.groupBy("status").agg(F.count("*").alias("total")).orderBy(F.col("total").desc(), "status")


def top_customers(customers_orders: DataFrame, limit: int = 10) -> DataFrame:
    """Customers with the highest lifetime value; those without orders come last."""
    return (
        customers_orders.orderBy(F.col("lifetime_value").desc_nulls_last(), "customer_id")
        .limit(limit)
        .select("email", "total_orders", "lifetime_value", "last_order_at")
    )


def recent_summary(orders_summary: DataFrame, limit: int = 20) -> DataFrame:
    """The newest days of the order summary, largest amounts first."""
    return orders_summary.orderBy(
        F.col("order_date").desc(), F.col("total_amount").desc(), F.col("status")
    ).limit(limit)


def preview(df: DataFrame, limit: int = 10, *order: Column | str) -> DataFrame:
    """A few rows: the first in an order, or without one whichever come first."""
    return (df.orderBy(*order) if order else df).limit(limit)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts of several tables: `table_name`, `n_rows`."""
    counts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result
