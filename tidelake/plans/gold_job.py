"""The batch job: silver -> gold models, tested before they are published."""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession

from tidelake.operators.checks import Check, run_checks
from tidelake.operators.gold import STATUSES, customers_orders, orders_summary
from tidelake.operators.silver import live_rows
from tidelake.plans.silver_job import Outcome, append_log, run_log
from tidelake.session import build_session
from tidelake.sources.lake import publish_version, read_version, write_version

# The declared tests of the models and of the silver tables.
MODEL_CHECKS = {
    "orders_summary": (
        Check("not_null", "order_date"),
        Check("not_null", "status"),
        Check("accepted_values", "status", STATUSES),
        Check("not_null", "order_count"),
        Check("not_null", "total_amount"),
    ),
    "customers_orders": (
        Check("not_null", "customer_id"),
        Check("unique", "customer_id"),
        Check("not_null", "email"),
        Check("not_null", "total_orders"),
        Check("not_null", "lifetime_value"),
    ),
}

SILVER_CHECKS = {
    "orders": (
        Check("not_null", "order_id"),
        Check("unique", "order_id"),
        Check("not_null", "customer_id"),
        Check("not_null", "status"),
        Check("accepted_values", "status", STATUSES),
        Check("not_null", "_cdc_op"),
        Check("not_null", "_ingested_at"),
    ),
    "customers": (
        Check("not_null", "customer_id"),
        Check("unique", "customer_id"),
        Check("not_null", "email"),
        Check("not_null", "_ingested_at"),
    ),
}

# Customers without live orders have no lifetime value: reported, but no reason to hold the model back.
WARN_ONLY = {("customers_orders", "not_null", "lifetime_value")}


class ChecksFailed(ValueError):
    """A model broke its declared tests and was not published."""


def materialize(
    spark: SparkSession, name: str, df: DataFrame, checks: Sequence[Check] = (), warn_only: bool = False
) -> DataFrame:
    """Full refresh of a model: write the next version, test what was written, publish it if it passes.

    Returns the violations per check. A changed set of columns fails before anything is written.
    """
    version = write_version(spark, df, name)
    written = read_version(spark, name, version)
    model = name.split(".")[-1]
    if checks:
        report = run_checks(written, checks)
        rows = report.collect()  # one row per check
        broken = [
            r for r in rows if r["n_violations"] and (model, r["check_name"], r["column_name"]) not in WARN_ONLY
        ]
        if broken and not warn_only:
            raise ChecksFailed(f"{name}: {broken}")
        report = spark.createDataFrame(rows, report.schema)
    else:
        report = spark.createDataFrame([], "check_name string, column_name string, n_violations bigint")
    publish_version(spark, name, version)
    return report


def silver_violations(spark: SparkSession, silver: str = "silver") -> dict[str, list[Row]]:
    """The declared tests of the silver tables that their live rows break."""
    found = {}
    for table, checks in SILVER_CHECKS.items():
        report = run_checks(live_rows(spark.table(f"{silver}.{table}")), checks).collect()  # one row per check
        found[table] = [r for r in report if r["n_violations"]]
    return found


def refresh_gold(
    spark: SparkSession,
    silver: str = "silver",
    gold: str = "gold",
    sum_type: str = "double",
    log: str | None = None,
    run_id: str = "gold",
) -> dict[str, DataFrame]:
    """Both models from the silver tables, which are tested first; returns the violations per model.

    A decimal `sum_type` that holds the source's amounts makes the sums exact and repeatable. With `log`,
    what was refreshed, or what failed, is appended to the run log in that folder.
    """
    done: list[Outcome] = []
    start = time.monotonic()
    stage = "silver tests"
    try:
        for table, broken in silver_violations(spark, silver).items():
            if broken:
                raise ChecksFailed(f"{silver}.{table}: {broken}")
        reports = {}
        for stage, model in _models(spark, silver, sum_type).items():
            start = time.monotonic()
            reports[stage] = materialize(spark, f"{gold}.{stage}", model, MODEL_CHECKS[stage])
            done.append(Outcome(stage, "refreshed", time.monotonic() - start))
        return reports
    except Exception as error:
        done.append(Outcome(stage, "failed", time.monotonic() - start, error=f"{type(error).__name__}: {error}"))
        raise
    finally:
        if log:
            append_log(log, run_log(spark, run_id, done, "gold"))


def _models(spark: SparkSession, silver: str, sum_type: str) -> dict[str, DataFrame]:
    orders, customers = spark.table(f"{silver}.orders"), spark.table(f"{silver}.customers")
    return {
        "orders_summary": orders_summary(orders, sum_type),
        "customers_orders": customers_orders(customers, orders, sum_type),
    }


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--silver", default="silver")
    parser.add_argument("--gold", default="gold")
    parser.add_argument("--sum-type", default="double", help="for example decimal(18,2)")
    parser.add_argument("--log", help="folder of the run log")
    parser.add_argument("--run-id", default="gold")
    args = parser.parse_args(argv)
    spark = build_session("gold-refresh")
    for name, report in refresh_gold(spark, args.silver, args.gold, args.sum_type, args.log, args.run_id).items():
        print(name, report.collect())


if __name__ == "__main__":
    main()
