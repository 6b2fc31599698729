"""Gold: the two reporting models over silver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.operators.silver import live_rows

# The statuses of an order.
STATUSES = ("pending", "processing", "shipped", "delivered", "cancelled")


def _money_sum(amount: Column, sum_type: str) -> Column:
    """Sum of amounts as a double. With a decimal `sum_type` the sum does not depend on row order."""
    return F.sum(amount.cast(sum_type)).cast("double")


def orders_summary(orders: DataFrame, sum_type: str = "double") -> DataFrame:
    """Live orders per ingestion day and status: count and amount."""
    return (
        live_rows(orders)
        .groupBy(F.date_trunc("day", "_ingested_at").alias("order_date"), "status")
        .agg(F.count("*").alias("order_count"), _money_sum(F.col("amount"), sum_type).alias("total_amount"))
    )


def customers_orders(customers: DataFrame, orders: DataFrame, sum_type: str = "double") -> DataFrame:
    """Live customers with their live orders: count, lifetime value (null without orders), last order.

    Orders are summed per customer before the join, so a customer with very many orders is folded in
    the map tasks and the join sees one row per customer. `customer_id` is unique in silver.
    """
    per_customer = (
        live_rows(orders)
        .filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.count("order_id").alias("total_orders"),
            _money_sum(F.col("amount"), sum_type).alias("lifetime_value"),
            F.max("_ingested_at").alias("last_order_at"),
        )
    )
    return (
        live_rows(customers)
        .select("customer_id", "email")
        .join(per_customer, "customer_id", "left")
        .select(
            "customer_id",
            "email",
            F.coalesce("total_orders", F.lit(0).cast("bigint")).alias("total_orders"),
            "lifetime_value",
            "last_order_at",
        )
    )
