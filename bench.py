"""Times the stages of the pipeline and prints one JSON line.

The change stream is derived from the test tables and written to the scratch folder first; that is not
timed. Every stage is run once to warm up and then `BENCH_RUNS` times; the fastest run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidelake import fixtures as fx  # noqa: E402
from tidelake.operators import bronze, capture, checks, gold, silver  # noqa: E402
from tidelake.session import build_session, scratch_dir  # noqa: E402
from tidelake.sources.lake import BronzeFiles  # noqa: E402
from tidelake.streaming.bronze_stream import start_bronze  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
MONEY = "decimal(18,2)"
AT = "2024-03-01 00:00:00"


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{CPUS}]",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": CPUS,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = scratch_dir(spark, "bench")
    load = lambda name: fx.table(spark, SF_DIR, name)

    raw_path = f"{folder}/changes"
    fx.all_changes(load).repartition(int(CPUS) * 2).write.parquet(raw_path)
    raw = spark.read.parquet(raw_path)
    n_changes = raw.count()
    store = BronzeFiles(f"{folder}/bronze")
    steps = iter(range(10**6))

    def validate_split() -> None:
        store.write(bronze.to_bronze(raw, fx.CONTRACTS, ingested_at=AT), 0)

    def changes(table: str) -> DataFrame:
        contract = fx.CONTRACTS[table]
        return silver.dedup_changes(silver.parse_envelope(store.read(spark, table), contract), contract)

    def write_silver(table: str) -> DataFrame:
        path = f"{folder}/silver-{table}-{next(steps)}"
        rows = changes(table)
        merged = silver.merge_frames(spark.createDataFrame([], rows.schema), rows, fx.CONTRACTS[table].keys)
        merged.write.parquet(path)
        return spark.read.parquet(path)

    def merge_batch(merge) -> None:
        """The updates and deletes again, onto the stored orders."""
        rows = silver.parse_envelope(store.read(spark, "orders"), fx.ORDERS).filter("_cdc_op <> 'r'")
        batch_path = f"{folder}/batch-{next(steps)}"
        silver.dedup_changes(rows, fx.ORDERS).write.parquet(batch_path)
        merge(orders, spark.read.parquet(batch_path), ["order_id"]).write.parquet(f"{folder}/merged-{next(steps)}")

    def stream() -> None:
        run = f"{folder}/stream-{next(steps)}"
        source = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 4).parquet(raw_path)
        start_bronze(source, BronzeFiles(f"{run}/bronze"), f"{run}/checkpoint", fx.CONTRACTS, interval=None).awaitTermination()

    seconds: dict[str, float] = {}

    def measure(name: str, step) -> None:
        step()
        best = float("inf")
        for _ in range(RUNS):
            start = time.perf_counter()
            step()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)

    measure("bronze_validate_split", validate_split)
    measure("silver_dedup_merge_orders", lambda: write_silver("orders"))
    measure("silver_dedup_merge_events", lambda: write_silver("events"))
    orders, customers = write_silver("orders"), write_silver("customers")
    measure("silver_merge_batch_join", lambda: merge_batch(silver.merge_frames))
    measure("silver_merge_batch_lookup", lambda: merge_batch(silver.merge_small_batch))
    lines = load("lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    measure(
        "silver_composite_key",
        lambda: consume(silver.latest_per_key(lines, keys, silver.newest_first(lines, keys, ["l_shipdate"]))),
    )
    measure("gold_orders_summary", lambda: consume(gold.orders_summary(orders, MONEY)))
    measure("gold_customers_orders", lambda: consume(gold.customers_orders(customers, orders, MONEY)))
    measure("test_unique", lambda: consume(checks.unique(lines, keys)))
    old, new = fx.old_customers(load("customer")), fx.new_customers(load("customer"))
    measure("diff_to_cdc", lambda: consume(capture.diff_to_cdc(old, new, "customers", ["customer_id"], F.lit(0))))
    measure("bronze_stream", stream)

    total = round(sum(seconds.values()), 3)
    rate = round(n_changes / seconds["bronze_validate_split"])
    print(
        json.dumps(
            {
                "metric": "pipeline_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "change_records": n_changes,
                "bronze_records_per_sec": rate,
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
