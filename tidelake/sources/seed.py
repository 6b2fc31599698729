"""Seed rows for a source database, and the insert that skips what is already there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators.silver import latest_per_key


def number_series(spark: SparkSession, n: int) -> DataFrame:
    """1..n in a column `i`."""
    return spark.range(1, n + 1).withColumnRenamed("id", "i")


def status_of(i: Column) -> Column:
    """Order status by number, in turns of five."""
    return (
        F.when(i % 5 == 0, "pending")
        .when(i % 5 == 1, "processing")
        .when(i % 5 == 2, "shipped")
        .when(i % 5 == 3, "delivered")
        .otherwise("cancelled")
    )


def email_of(i: Column) -> Column:
    return F.concat(F.lit("customer_"), i.cast("string"), F.lit("@example.com"))


def _created(created_at: Column | None) -> list[Column]:
    return [] if created_at is None else [created_at.cast("timestamp").alias("created_at")]


def seed_customers(series: DataFrame, created_at: Column | None = None) -> DataFrame:
    """One customer per number of the column `i`; `created_at`, for example the time of the run, is a further column."""
    i = F.col("i")
    return series.select(
        i.alias("customer_id"),
        email_of(i).alias("email"),
        F.concat(F.lit("Customer "), i.cast("string")).alias("name"),
        *_created(created_at),
    )


def seed_orders(
    series: DataFrame, n_customers: int, seed: int | None = None, created_at: Column | None = None
) -> DataFrame:
    """One order per number, spread over customers 1..n_customers, with a random amount below 1000."""
    i = F.col("i")
    return series.select(
        i.alias("order_id"),
        (i % n_customers + 1).alias("customer_id"),
        status_of(i).alias("status"),
        (F.rand(seed) * 1000).cast("decimal(10,2)").alias("amount"),
        *_created(created_at),
    )


def seed_items(series: DataFrame) -> DataFrame:
    """The test item rows: `item_i` worth `i * 1.5`."""
    i = F.col("i")
    return series.select(
        F.concat(F.lit("item_"), i.cast("string")).alias("name"), (i * F.lit(1.5)).cast("decimal(10,2)").alias("value")
    )


def insert_if_absent(
    existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[Column] | None = None
) -> DataFrame:
    """The incoming rows to append: keys not stored yet, the first row in `order` per key.

    As under a unique constraint, a null in the key never clashes: such rows all go in. They bypass
    the per-key step, so they cannot pile up in one task.
    """
    key = list(key)
    has_key = F.lit(True)
    for name in key:
        has_key = has_key & F.col(name).isNotNull()
    order = list(order) if order else [F.col(c) for c in incoming.columns if c not in key] or [F.lit(1)]
    fresh = latest_per_key(incoming.filter(has_key), key, order).join(existing.select(*key), key, "left_anti")
    return fresh.select(*incoming.columns).unionByName(incoming.filter(~has_key))
