"""The queries of this repository on the test tables, each with the SQL that gives the same result.

Change streams are derived from the tables by the rules in FIXTURES.md; the SQL computes the expected
result from the tables directly, without going through JSON.
"""

from __future__ import annotations

import functools
import os
import sys
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidelake import fixtures as fx  # noqa: E402
from tidelake.functions.contracts import BrokenContract, Contract, Field  # noqa: E402
from tidelake.functions.envelope import json_field, parse_records, table_of  # noqa: E402
from tidelake.operators import bronze, capture, checks, consume, gold, profile, quarantine, report, silver  # noqa: E402
from tidelake.plans.silver_job import SilverOptions, merge_all, merge_day  # noqa: E402
from tidelake.session import scratch_dir  # noqa: E402
from tidelake.sources import kafka, seed  # noqa: E402
from tidelake.sources.keyed import KeyedTable  # noqa: E402
from tidelake.sources.lake import BronzeFiles, read_counts  # noqa: E402
from tidelake.streaming.bronze_stream import start_bronze  # noqa: E402
from tidelake.streaming.progress import ProgressLog  # noqa: E402

MONEY = "decimal(18,2)"
EVENTS_CUT = "2024-01-16 00:00:00"
LATENCY_INGESTED_AT = "2024-02-01 00:00:00"
DAY = "1998-10-04"
COMMITTED_UNTIL = "2024-01-25 00:00:00"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    """Register a query under a key, with its SQL."""

    def register(function: Query) -> Query:
        @functools.wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, sf_dir)

        _QUERIES[name] = run
        _ORACLE[name] = sql
        return run

    return register


# ---------------------------------------------------------------- shared frames


def _load(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: fx.table(spark, sf_dir, name)


_CHANGES = {
    "customers": ("customer", fx.customer_changes),
    "orders": ("orders", fx.order_changes),
    "events": ("events", fx.event_changes),
}


def _changes(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    source, derive = _CHANGES[table]
    return derive(fx.table(spark, sf_dir, source))


def _bronze(spark: SparkSession, sf_dir: str, table: str, contract: Contract | None = None) -> DataFrame:
    contracts = {table: contract or fx.CONTRACTS[table]}
    return bronze.to_bronze(_changes(spark, sf_dir, table), contracts, ingested_at=F.col("timestamp"))


def _all_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = fx.all_changes(_load(spark, sf_dir))
    return bronze.to_bronze(changes, fx.CONTRACTS, ingested_at=F.col("timestamp"))


def _valid(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return bronze.valid_rows(_bronze(spark, sf_dir, table), table)


def _latest(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    contract = fx.CONTRACTS[table]
    return silver.dedup_changes(silver.parse_envelope(_valid(spark, sf_dir, table), contract), contract)


def _empty_silver(spark: SparkSession, like: DataFrame) -> DataFrame:
    return spark.createDataFrame([], like.schema)


def _silver(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    changes = _latest(spark, sf_dir, table)
    return silver.merge_frames(_empty_silver(spark, changes), changes, fx.CONTRACTS[table].keys)


def _stored(spark: SparkSession, df: DataFrame, purpose: str) -> DataFrame:
    """A frame several results are computed from, written once to the scratch folder."""
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _naive(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz").alias(column.lstrip("_"))


# The fixture rules in SQL: event changes, order changes, customers, and the silver tables they end in.
_EV = """
ev AS (
  SELECT event_id, user_id, event_type, value, ts, epoch_us(ts) // 1000 AS ts_ms,
         CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op,
         event_id % 89 = 0 AS broken,
         event_id % 89 <> 0 AND event_type <> 'error' AND event_id % 97 = 0 AS lost
  FROM events
)"""
_EV_LATEST = (
    _EV
    + """,
ev_latest AS (
  SELECT user_id, event_id, event_type, value, op, ts FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, event_id DESC) AS rn
    FROM ev WHERE NOT broken AND NOT lost) WHERE rn = 1
)"""
)
_OC = """
oc AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, 0 AS step, 'r' AS op,
         CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'shipped'
                             WHEN 3 THEN 'delivered' ELSE 'cancelled' END AS status,
         o_totalprice AS amount, o_orderdate AS changed_at
  FROM orders
  UNION ALL
  SELECT o_orderkey, o_custkey, 1, 'u', 'delivered', o_totalprice, o_orderdate + INTERVAL 1 DAY
  FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL
  SELECT o_orderkey, o_custkey, 2, 'd',
         CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'shipped'
                             WHEN 3 THEN 'delivered' ELSE 'cancelled' END,
         o_totalprice, o_orderdate + INTERVAL 2 DAY
  FROM orders WHERE o_orderkey % 11 = 0
)"""
_SO = (
    _OC
    + """,
so AS (
  SELECT * FROM oc AS a
  WHERE a.op <> 'd' AND NOT EXISTS (SELECT 1 FROM oc AS b WHERE b.order_id = a.order_id AND b.step > a.step)
)"""
)
_SC = """
sc AS (
  SELECT c_custkey AS customer_id, 'customer_' || c_custkey || '@example.com' AS email, c_name AS name FROM customer
)"""
_GS = (
    _SO
    + """,
gs AS (
  SELECT CAST(date_trunc('day', changed_at) AS DATE) AS order_date, status, count(*) AS order_count,
         CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
  FROM so GROUP BY 1, 2
)"""
)
_GC = (
    _SO
    + ","
    + _SC
    + """,
gc AS (
  SELECT c.customer_id, c.email, count(o.order_id) AS total_orders,
         CAST(sum(CAST(o.amount AS DECIMAL(18,2))) AS DOUBLE) AS lifetime_value, max(o.changed_at) AS last_order_at
  FROM sc c LEFT JOIN so o ON o.customer_id = c.customer_id
  GROUP BY 1, 2
)"""
)


# ---------------------------------------------------------------- sources


@query(
    "topic_to_table",
    f"""WITH {_OC}
SELECT 'cdc.public.customers' AS topic, 'customers' AS table_name, count(*) AS n_records FROM customer
UNION ALL SELECT 'cdc.public.orders', 'orders', count(*) FROM oc
UNION ALL SELECT 'cdc.public.events', 'events', count(*) FROM events""",
)
def topic_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = fx.all_changes(_load(spark, sf_dir))
    return changes.groupBy("topic", table_of("topic").alias("table_name")).agg(F.count("*").alias("n_records"))


@query(
    "topic_offsets",
    f"""WITH {_OC}, rec AS (
  SELECT 'cdc.public.customers' AS topic, c_custkey % 3 AS p, c_custkey AS o FROM customer
  UNION ALL SELECT 'cdc.public.orders', order_id % 3, order_id * 3 + step FROM oc
  UNION ALL SELECT 'cdc.public.events', event_id % 3, event_id FROM events)
SELECT topic, CAST(p AS INTEGER) AS "partition", min(o) AS begin_offset, max(o) + 1 AS end_offset, count(*) AS n_records
FROM rec GROUP BY 1, 2""",
)
def topic_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.topic_offsets(fx.all_changes(_load(spark, sf_dir)))


@query(
    "list_topics",
    "SELECT DISTINCT 'cdc.public.' || event_type AS topic FROM events WHERE event_type LIKE '%i%'",
)
def list_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic for each event type; those that match a pattern."""
    return report.list_topics(fx.event_type_changes(fx.table(spark, sf_dir, "events")), r"cdc\.public\..*i.*")


@query(
    "cdc_bounded_read",
    f"""WITH {_EV}
SELECT CAST(event_id % 3 AS INTEGER) AS "partition", event_id AS "offset", CASE WHEN broken THEN NULL ELSE op END AS op
FROM ev WHERE event_id % 3 = 0 AND event_id >= 100 ORDER BY event_id LIMIT 10""",
)
def cdc_bounded_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _changes(spark, sf_dir, "events")
    rows = kafka.bounded_slice(changes, capture.topic_of("events"), 0, 100, 10)
    return rows.select("partition", "offset", json_field("value", "op").alias("op"))


@query(
    "bronze_day_slice",
    f"""WITH {_OC}
SELECT order_id * 3 + step AS "offset", op AS cdc_op FROM oc
WHERE changed_at >= TIMESTAMP '{DAY} 00:00:00' AND changed_at < TIMESTAMP '{DAY} 00:00:00' + INTERVAL 1 DAY""",
)
def bronze_day_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bronze.day_slice(_valid(spark, sf_dir, "orders"), DAY)
    return rows.select(F.col("_offset").alias("offset"), F.col("_cdc_op").alias("cdc_op"))


@query(
    "seed_customers",
    """SELECT c_custkey + 1 AS customer_id, 'customer_' || (c_custkey + 1) || '@example.com' AS email,
       'Customer ' || (c_custkey + 1) AS name, make_timestamp(CAST((c_custkey + 1) * 1000000 AS BIGINT)) AS created_at FROM customer""",
)
def seed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = fx.table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("i"))
    rows = seed.seed_customers(series, F.timestamp_seconds("i"))
    return rows.select("customer_id", "email", "name", _naive("created_at"))


@query(
    "seed_orders",
    """SELECT i AS order_id, i % n + 1 AS customer_id,
       CASE i % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'shipped' WHEN 3 THEN 'delivered'
                  ELSE 'cancelled' END AS status,
       TRUE AS amount_in_range, make_timestamp(CAST(i * 1000000 AS BIGINT)) AS created_at
FROM (SELECT o_orderkey + 1 AS i FROM orders), (SELECT count(*) AS n FROM customer)""",
)
def seed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = fx.table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("i"))
    rows = seed.seed_orders(series, fx.table(spark, sf_dir, "customer").count(), seed=42, created_at=F.timestamp_seconds("i"))
    in_range = F.col("amount").between(0, 1000).alias("amount_in_range")
    return rows.select("order_id", "customer_id", "status", in_range, _naive("created_at"))


@query(
    "seed_items",
    """SELECT 'item_' || p_partkey AS name, CAST(p_partkey * 1.5 AS DOUBLE) AS value FROM part""",
)
def seed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seed.seed_items(fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i")))
    return rows.select("name", F.col("value").cast("double"))


@query(
    "insert_if_absent",
    """WITH incoming AS (
  SELECT c_custkey, c_name AS name FROM customer
  UNION ALL
  SELECT c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN upper(c_name) ELSE c_name END
  FROM customer WHERE c_acctbal >= 0)
SELECT c_custkey AS customer_id, 'customer_' || c_custkey || '@example.com' AS email, min(name) AS name
FROM incoming AS i
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = i.c_custkey AND c.c_mktsegment <> 'MACHINERY')
GROUP BY 1, 2""",
)
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = fx.table(spark, sf_dir, "customer")
    incoming = fx.customers(customer).unionByName(fx.new_customers(customer))
    return seed.insert_if_absent(fx.old_customers(customer), incoming, ["email"], [F.col("name")])


# ---------------------------------------------------------------- envelope and bronze


@query(
    "cdc_op_counts",
    f"WITH {_OC} SELECT op AS _cdc_op, count(*) AS total FROM oc GROUP BY 1",
)
def cdc_op_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consume.op_counts(_valid(spark, sf_dir, "orders"))


@query(
    "distinct_ops",
    f"WITH {_EV} SELECT DISTINCT op AS _cdc_op FROM ev WHERE NOT broken AND NOT lost",
)
def distinct_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consume.distinct_ops(_valid(spark, sf_dir, "events"))


@query("ops_present", f"WITH {_OC} SELECT bool_or(op IN ('c', 'r', 'u')) AS present FROM oc")
def ops_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.ops_present(_valid(spark, sf_dir, "orders"))


@query(
    "cdc_event_time",
    f"""WITH {_EV} SELECT event_id AS "offset", ts_ms AS cdc_ts_ms FROM ev WHERE NOT broken AND NOT lost""",
)
def cdc_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _valid(spark, sf_dir, "events")
    return rows.select(F.col("_offset").alias("offset"), F.unix_millis("_cdc_ts").alias("cdc_ts_ms"))


@query(
    "cdc_latency",
    f"""WITH {_EV}
SELECT event_id AS "offset", op AS cdc_op, epoch_us(TIMESTAMP '{LATENCY_INGESTED_AT}') - ts_ms * 1000 AS latency_us
FROM ev WHERE NOT broken AND NOT lost""",
)
def cdc_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _changes(spark, sf_dir, "events")
    stamped = bronze.to_bronze(changes, fx.CONTRACTS, ingested_at=F.lit(LATENCY_INGESTED_AT))
    rows = consume.latency(bronze.valid_rows(stamped, "events"))
    return rows.select(F.col("_offset").alias("offset"), F.col("_cdc_op").alias("cdc_op"), "latency_us")


@query(
    "malformed_records",
    f"""WITH {_EV} SELECT event_id AS "offset", 'malformed json' AS defect FROM ev WHERE broken""",
)
def malformed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_records(_changes(spark, sf_dir, "events"), "value", None)
    return parsed.filter(F.col("_defect").isNotNull()).select("offset", F.col("_defect").alias("defect"))


@query(
    "contract_errors",
    f"""WITH {_EV}
SELECT event_id AS "offset",
       CASE WHEN broken THEN 'malformed json' WHEN lost THEN 'user_id: required' ELSE '' END AS validation_error
FROM ev""",
)
def contract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bronze(spark, sf_dir, "events")
    return rows.select(F.col("_offset").alias("offset"), F.col("_validation_error").alias("validation_error"))


@query(
    "contract_type_errors",
    f"""WITH {_EV}
SELECT event_id AS "offset",
       CASE WHEN broken THEN 'malformed json' WHEN op = 'd' THEN ''
            WHEN lost THEN 'user_id: required; event_type: type; value: type'
            ELSE 'event_type: type; value: type' END AS validation_error
FROM ev""",
)
def contract_type_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bronze(spark, sf_dir, "events", fx.EVENTS_STRICT)
    return rows.select(F.col("_offset").alias("offset"), F.col("_validation_error").alias("validation_error"))


@query(
    "contract_type_rules",
    """SELECT o_orderkey AS "offset",
       CASE o_orderkey % 13 WHEN 1 THEN 'i: type' WHEN 2 THEN 'f: type' WHEN 3 THEN 'd: type' WHEN 4 THEN 'n: type'
            WHEN 5 THEN 'b: type' WHEN 6 THEN 's: type' WHEN 7 THEN 't: type' WHEN 8 THEN 'created_at: type'
            WHEN 9 THEN 'day: type' WHEN 10 THEN 'o: type' WHEN 11 THEN 'x: type' ELSE '' END AS validation_error
FROM orders""",
)
def contract_type_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of every contract type, and records in which one of them is wrong."""
    changes = fx.typed_changes(fx.table(spark, sf_dir, "orders"))
    rows = bronze.to_bronze(changes, {"typed": fx.TYPED}, ingested_at=F.col("timestamp"))
    return rows.select(F.col("_offset").alias("offset"), F.col("_validation_error").alias("validation_error"))


@query(
    "parse_typed_fields",
    """SELECT o_orderkey AS id, o_orderkey AS i, CAST(1.5 AS FLOAT) AS f, CAST(2.5 AS DOUBLE) AS d, o_totalprice AS n, TRUE AS b,
       '[text' AS s, 'text' AS t, epoch_us(o_orderdate) AS created_at_us, o_orderdate AS created_at,
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, '{"a":' || o_orderkey || '}' AS o, 'YWJj' AS x
FROM orders WHERE o_orderkey % 13 IN (0, 12)""",
)
def parse_typed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound ones of these records parsed, timestamps both as microseconds and as timestamps."""
    changes = fx.typed_changes(fx.table(spark, sf_dir, "orders"))
    valid = bronze.valid_rows(bronze.to_bronze(changes, {"typed": fx.TYPED}, ingested_at=F.col("timestamp")), "typed")
    as_long = silver.parse_envelope(valid, fx.TYPED).withColumnRenamed("created_at", "created_at_us")
    as_time = silver.parse_envelope(valid, fx.TYPED, "timestamp").select("id", _naive("created_at"))
    names = [f.name for f in fx.TYPED.fields if f.name != "created_at"]
    joined = as_long.join(as_time, "id").withColumn("i", F.col("i").cast("bigint"))
    return joined.select(*names, "created_at_us", "created_at")


@query(
    "bronze_valid",
    f"""WITH {_EV}, {_OC}
SELECT 'cdc.public.customers' AS source_topic, 'r' AS cdc_op, c_custkey AS "offset",
       epoch_ms(TIMESTAMP '{fx.CUSTOMERS_AT}') AS cdc_ts_ms FROM customer
UNION ALL SELECT 'cdc.public.orders', op, order_id * 3 + step, epoch_ms(changed_at) FROM oc
UNION ALL SELECT 'cdc.public.events', op, event_id, ts_ms FROM ev WHERE NOT broken AND NOT lost""",
)
def bronze_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze.valid_rows(_all_bronze(spark, sf_dir)).select(
        F.col("_source_topic").alias("source_topic"),
        F.col("_cdc_op").alias("cdc_op"),
        F.col("_offset").alias("offset"),
        F.unix_millis("_cdc_ts").alias("cdc_ts_ms"),
    )


@query(
    "bronze_invalid",
    f"""WITH {_EV}
SELECT 'cdc.public.events' AS source_topic, event_id AS "offset",
       CASE WHEN broken THEN 'malformed json' ELSE 'user_id: required' END AS validation_error
FROM ev WHERE broken OR lost""",
)
def bronze_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze.invalid_rows(_all_bronze(spark, sf_dir)).select(
        F.col("_source_topic").alias("source_topic"),
        F.col("_offset").alias("offset"),
        F.col("_validation_error").alias("validation_error"),
    )


@query(
    "missing_contract_policy",
    f"""WITH {_OC}
SELECT 'pass' AS policy, 'orders' AS table_name, '' AS validation_error, count(*) AS n_records FROM oc
UNION ALL SELECT 'pass', 'events', '', count(*) FROM events
UNION ALL SELECT 'fail', 'orders', '', count(*) FROM oc
UNION ALL SELECT 'fail', 'events', 'contract not found: events', count(*) FROM events""",
)
def missing_contract_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _changes(spark, sf_dir, "orders").unionByName(_changes(spark, sf_dir, "events"))

    def counts(policy: str) -> DataFrame:
        rows = bronze.to_bronze(changes, {"orders": fx.ORDERS}, policy, F.col("timestamp"))
        return rows.groupBy(
            F.lit(policy).alias("policy"), F.col("_table").alias("table_name"), F.col("_validation_error").alias("validation_error")
        ).agg(F.count("*").alias("n_records"))

    return counts("pass").unionByName(counts("fail"))


_ROUTING_SQL = f"""WITH {_EV}, {_OC}
SELECT 'customers' AS table_name, 'valid' AS status, count(*) AS n_rows FROM customer
UNION ALL SELECT 'orders', 'valid', count(*) FROM oc
UNION ALL SELECT 'events', CASE WHEN broken OR lost THEN 'invalid' ELSE 'valid' END, count(*) FROM ev GROUP BY 2"""


@query("bronze_routing_counts", _ROUTING_SQL)
def bronze_routing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bronze.routing_counts(_all_bronze(spark, sf_dir))
    return counts.select(F.col("_table").alias("table_name"), F.col("_status").alias("status"), "n_rows")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # a pattern, because a streaming source does not take the path of a single file
    return spark.readStream.schema(fx.table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


def _run_stream(changes: DataFrame, store: BronzeFiles, checkpoint: str) -> None:
    start_bronze(changes, store, checkpoint, fx.CONTRACTS, interval=None).awaitTermination()


def _stored_counts(spark: SparkSession, store: BronzeFiles) -> DataFrame:
    def counts(status: str) -> DataFrame:
        rows = store.read(spark, status=status)
        return rows.groupBy(F.col("_table").alias("table_name"), F.lit(status).alias("status")).agg(
            F.count("*").alias("n_rows")
        )

    return counts("valid").unionByName(counts("invalid"))


@query("bronze_stream_counts", _ROUTING_SQL)
def bronze_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming job over the three topics until it has read everything, then the written pairs counted."""
    folder = scratch_dir(spark, "bronze-stream")
    store = BronzeFiles(f"{folder}/bronze")
    _run_stream(fx.all_changes(lambda name: _stream(spark, sf_dir, name)), store, f"{folder}/checkpoint")
    return _stored_counts(spark, store)


@query("bronze_two_streams_counts", f"SELECT table_name, status, 2 * n_rows AS n_rows FROM ({_ROUTING_SQL}) WHERE n_rows > 0")
def bronze_two_streams_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams with checkpoints of their own into one root: both start at batch 0, and all rows stay."""
    folder = scratch_dir(spark, "bronze-two-streams")
    store = BronzeFiles(f"{folder}/bronze")
    streams = [
        start_bronze(fx.all_changes(lambda name: _stream(spark, sf_dir, name)), store, f"{folder}/{checkpoint}", fx.CONTRACTS, interval=None)
        for checkpoint in ("one", "two")
    ]  # at once, as two jobs run: one fills the cores that the last tasks of the other leave
    for stream in streams:
        stream.awaitTermination()
    return _stored_counts(spark, store)


@query("bronze_compacted_counts", _ROUTING_SQL)
def bronze_compacted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream per table into one root, then the day folded into few files."""
    folder = scratch_dir(spark, "bronze-compacted")
    store = BronzeFiles(f"{folder}/bronze")
    for table, (source, derive) in _CHANGES.items():
        _run_stream(derive(_stream(spark, sf_dir, source)), store, f"{folder}/{table}")
    days = store.read(spark).select(F.date_format("_ingested_at", "yyyy-MM-dd")).distinct().collect()  # one, or two at midnight
    for (day,) in days:
        store.compact_day(spark, day)
    return _stored_counts(spark, store)


@query("bronze_compacted_late_batch", _ROUTING_SQL)
def bronze_compacted_late_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day folded while the batches of one more stream arrive, after the rows were read and before the old ones go."""
    folder = scratch_dir(spark, "bronze-late")
    store = BronzeFiles(f"{folder}/bronze")

    def run(table: str) -> None:
        source, derive = _CHANGES[table]
        _run_stream(derive(_stream(spark, sf_dir, source)), store, f"{folder}/{table}")

    run("customers")
    run("orders")
    days = store.read(spark).select(F.date_format("_ingested_at", "yyyy-MM-dd")).distinct().collect()  # one, or two at midnight
    for n, (day,) in enumerate(days):
        for step in store.fold_steps(spark, day):
            if n == 0 and step == "written":
                run("events")
    return _stored_counts(spark, store)


@query(
    "footer_offsets",
    f"""WITH {_OC}, rec AS (
  SELECT 'customers' AS table_name, c_custkey % 3 AS p, c_custkey AS o FROM customer
  UNION ALL SELECT 'orders', order_id % 3, order_id * 3 + step FROM oc
  UNION ALL SELECT 'events', event_id % 3, event_id FROM events)
SELECT table_name, CAST(p AS INTEGER) AS "partition", min(o) AS begin_offset, max(o) + 1 AS end_offset, count(*) AS n_records
FROM rec GROUP BY 1, 2""",
)
def footer_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored offsets: of two topics in batches of one partition each from the footers, of one in a mixed batch by reading it."""
    store = BronzeFiles(f"{scratch_dir(spark, 'footer-offsets')}/bronze")
    for table in _CHANGES:
        rows = _changes(spark, sf_dir, table)
        parts = [rows] if table == "events" else [rows.where(F.col("partition") == p) for p in range(3)]
        for n, part in enumerate(parts):
            store.write(bronze.to_bronze(part, fx.CONTRACTS, ingested_at=f"{DAY} 10:00:00"), n, table, DAY)
    return store.offsets(spark)


@query("footer_counts", _ROUTING_SQL)
def footer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a stored day counted by their footers."""
    store = BronzeFiles(f"{scratch_dir(spark, 'footer-counts')}/bronze")
    changes = fx.all_changes(_load(spark, sf_dir))
    store.write(bronze.to_bronze(changes, fx.CONTRACTS, ingested_at=f"{DAY} 10:00:00"), 0, day=DAY)
    return store.counts(spark, DAY)


@query(
    "preview",
    f"""WITH {_OC} SELECT order_id * 3 + step AS "offset", op AS cdc_op FROM oc ORDER BY 1 LIMIT 10""",
)
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = consume.preview(_valid(spark, sf_dir, "orders"), 10, "_offset")
    return rows.select(F.col("_offset").alias("offset"), F.col("_cdc_op").alias("cdc_op"))


@query(
    "json_field_lookup",
    f"""WITH {_SC} SELECT customer_id AS "offset", 'r' AS cdc_op, email FROM sc WHERE email = 'customer_46@example.com'""",
)
def json_field_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = consume.json_field_lookup(_valid(spark, sf_dir, "customers"), "after.email", "customer_46@example.com")
    return rows.select(
        F.col("_offset").alias("offset"), F.col("_cdc_op").alias("cdc_op"), json_field("_raw_value", "after.email").alias("email")
    )


@query(
    "latest_changes",
    f"""WITH {_EV}
SELECT 'cdc.public.events' AS source_topic, op AS cdc_op, ts AS ingested_at,
       CASE WHEN op <> 'd' THEN event_type END AS event_type
FROM ev WHERE NOT broken AND NOT lost ORDER BY ts DESC, event_id DESC LIMIT 10""",
)
def latest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = consume.latest_changes(
        _valid(spark, sf_dir, "events"), "after.event_type", "event_type", 10, F.col("_offset").desc()
    )
    return rows.select(
        F.col("_source_topic").alias("source_topic"), F.col("_cdc_op").alias("cdc_op"), _naive("_ingested_at"), "event_type"
    )


# ---------------------------------------------------------------- silver


@query(
    "parse_envelope",
    f"""WITH {_OC} SELECT order_id, customer_id, status, amount, op AS cdc_op, order_id * 3 + step AS lsn,
       epoch_us(changed_at - step * INTERVAL 1 DAY) AS created_at FROM oc""",
)
def parse_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = silver.parse_envelope(_valid(spark, sf_dir, "orders"), fx.ORDERS)
    return rows.select(
        "order_id", "customer_id", "status", "amount", F.col("_cdc_op").alias("cdc_op"), F.col("_lsn").alias("lsn"), "created_at"
    )


@query(
    "parse_envelope_timestamps",
    f"""WITH {_SC} SELECT customer_id, email, TIMESTAMP '{fx.CUSTOMERS_AT}' + customer_id * INTERVAL 1 SECOND AS created_at FROM sc""",
)
def parse_envelope_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = silver.parse_envelope(_valid(spark, sf_dir, "customers"), fx.CUSTOMERS, "timestamp")
    return rows.select("customer_id", "email", _naive("created_at"))


@query(
    "silver_dedup",
    f"WITH {_EV_LATEST} SELECT user_id, event_id, event_type, value, op AS cdc_op, ts AS ingested_at FROM ev_latest",
)
def silver_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _latest(spark, sf_dir, "events")
    return rows.select(
        "user_id", "event_id", "event_type", "value", F.col("_cdc_op").alias("cdc_op"), _naive("_ingested_at")
    )


@query(
    "silver_merge",
    f"WITH {_EV_LATEST} SELECT user_id, event_id, event_type, value, op AS cdc_op FROM ev_latest WHERE op <> 'd'",
)
def silver_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: everything before a point in time, then everything after it."""
    rows = silver.parse_envelope(_valid(spark, sf_dir, "events"), fx.EVENTS)
    first = silver.dedup_changes(rows.filter(F.col("_ingested_at") < F.lit(EVENTS_CUT).cast("timestamp")), fx.EVENTS)
    second = silver.dedup_changes(rows.filter(F.col("_ingested_at") >= F.lit(EVENTS_CUT).cast("timestamp")), fx.EVENTS)
    stored = silver.merge_frames(_empty_silver(spark, first), first, ["user_id"])
    merged = silver.merge_frames(stored, second, ["user_id"])
    return merged.select("user_id", "event_id", "event_type", "value", F.col("_cdc_op").alias("cdc_op"))


@query(
    "silver_merge_delete",
    f"WITH {_SO} SELECT order_id, customer_id, status, amount, op AS cdc_op FROM so",
)
def silver_merge_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot as the stored table, then updates and deletes merged into it without shuffling it."""
    rows = silver.parse_envelope(_valid(spark, sf_dir, "orders"), fx.ORDERS)
    stored = silver.dedup_changes(rows.filter(F.col("_cdc_op") == "r"), fx.ORDERS)
    changes = silver.dedup_changes(rows.filter(F.col("_cdc_op") != "r"), fx.ORDERS)
    stored, changes = _stored(spark, stored, "merge-stored"), _stored(spark, changes, "merge-changes")
    merged = silver.merge_small_batch(stored, changes, ["order_id"])
    return merged.select("order_id", "customer_id", "status", "amount", F.col("_cdc_op").alias("cdc_op"))


def _database(folder: str) -> str:
    return os.path.basename(folder).replace("-", "_")


@query(
    "silver_merge_touched",
    f"""WITH {_SO}, last AS (
  SELECT order_id, changed_at FROM oc AS a
  WHERE step > 0 AND NOT EXISTS (SELECT 1 FROM oc AS b WHERE b.order_id = a.order_id AND b.step > a.step))
SELECT order_id, customer_id, status, amount, op AS cdc_op,
       (SELECT count(DISTINCT order_id // 500) FROM last WHERE changed_at = (SELECT max(changed_at) FROM last)) AS buckets_read FROM so""",
)
def silver_merge_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot in ranges of keys, all updates and deletes merged, then those of the last day once more."""
    rows = _stored(spark, silver.parse_envelope(_valid(spark, sf_dir, "orders"), fx.ORDERS), "touched-rows")
    stored = silver.dedup_changes(rows.filter(F.col("_cdc_op") == "r"), fx.ORDERS)
    changes = silver.dedup_changes(rows.filter(F.col("_cdc_op") != "r"), fx.ORDERS)
    stored, changes = _stored(spark, stored, "touched-stored"), _stored(spark, changes, "touched-changes")
    table = KeyedTable(f"{_database(scratch_dir(spark, 'touched'))}.orders", ["order_id"], width=500)
    table.create(spark, stored.schema)
    table.merge(stored)
    table.merge(changes)
    last = changes.agg(F.max("_ingested_at").alias("_ingested_at"))
    touched = table.merge(_stored(spark, changes.join(last, "_ingested_at").select(*changes.columns), "touched-last"))
    columns = ["order_id", "customer_id", "status", "amount", F.col("_cdc_op").alias("cdc_op")]
    return table.read(spark).select(*columns, F.lit(len(touched)).cast("long").alias("buckets_read"))


@query(
    "silver_contract_grows",
    f"""WITH {_OC}, latest AS (
  SELECT * FROM oc AS a WHERE NOT EXISTS (SELECT 1 FROM oc AS b WHERE b.order_id = a.order_id AND b.step > a.step))
SELECT order_id, CASE WHEN step > 0 THEN customer_id END AS customer_id, CASE WHEN step = 0 THEN 'day one' END AS note, status,
       CASE WHEN step > 0 THEN amount ELSE CAST(CAST(amount AS FLOAT) AS DOUBLE) END AS amount, op AS cdc_op FROM latest""",
)
def silver_contract_grows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot under an early contract, the changes under today's: a field more, one less, two wider types."""
    folder = scratch_dir(spark, "contract-grows")
    store = BronzeFiles(f"{folder}/bronze")
    early = Contract(
        "orders",
        (Field("order_id", "integer", True, True), Field("note"), Field("status", "string", True), Field("amount", "float", True)),
    )
    changes = _changes(spark, sf_dir, "orders")
    noted = F.regexp_replace("value", '"status"', '"note":"day one","status"')
    first = changes.filter("offset % 3 = 0").withColumn("value", noted)
    options = SilverOptions(database=_database(folder))
    steps = [(first, early, "2024-01-01"), (changes.filter("offset % 3 <> 0"), fx.ORDERS, "2024-01-02")]
    for n, (rows, contract, day) in enumerate(steps):
        store.write(bronze.to_bronze(rows, {"orders": contract}, ingested_at=f"{day} 10:00:00"), n)
        merge_day(spark, store, contract, day, options=options)
    rows = spark.table(f"{options.database}.orders")
    return rows.select("order_id", "customer_id", "note", "status", "amount", F.col("_cdc_op").alias("cdc_op"))


@query(
    "silver_unique_enforced",
    """WITH c AS (SELECT c_custkey AS k, 'customer_' || c_custkey || '@example.com' AS email,
             EXISTS (SELECT 1 FROM customer b WHERE b.c_custkey = a.c_custkey + 1) AS next_exists FROM customer a
), w AS (
  SELECT *, CASE k % 10 WHEN 3 THEN 'customer_' || (k + 1) || '@example.com' WHEN 4 THEN 'moved_' || k || '@example.com'
                        WHEN 5 THEN 'customer_' || (k + 1) || '@example.com' WHEN 7 THEN 'same_' || (k // 20) || '@example.com'
                        WHEN 8 THEN 'customer_' || (k - 3) || '@example.com' END AS wanted,
         CASE k % 10 WHEN 5 THEN next_exists WHEN 7 THEN k // 20 = (k - 10) // 20 AND k > 10 WHEN 8 THEN TRUE ELSE FALSE END AS held FROM c
)
SELECT k AS customer_id, CASE WHEN held OR wanted IS NULL THEN email ELSE wanted END AS email,
       CASE WHEN held THEN 'email: unique' END AS held_back FROM w""",
)
def silver_unique_enforced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who change their address: to one that another gives up, keeps, claims as well, or would have given up."""
    folder = scratch_dir(spark, "unique-enforced")
    store = BronzeFiles(f"{folder}/bronze")
    first = _changes(spark, sf_dir, "customers")
    key = F.col("customer_id")
    address = lambda name, number: F.concat(F.lit(f"{name}_"), number.cast("string"), F.lit("@example.com"))
    wanted = (
        F.when(key % 10 == 3, address("customer", key + 1))
        .when(key % 10 == 4, address("moved", key))
        .when(key % 10 == 5, address("customer", key + 1))
        .when(key % 10 == 7, address("same", F.floor(key / 20)))
        .when(key % 10 == 8, address("customer", key - 3))
    )
    old = fx.customers(fx.table(spark, sf_dir, "customer"))
    new = old.withColumn("email", F.coalesce(wanted, "email"))
    moves = capture.diff_to_cdc(old, new, "customers", ["customer_id"], F.lit(1704200000000))
    options = SilverOptions(database=_database(folder))
    for n, (rows, day) in enumerate([(first, "2024-01-01"), (moves, "2024-01-02")]):
        store.write(bronze.to_bronze(rows, {"customers": fx.CUSTOMERS}, ingested_at=f"{day} 10:00:00"), n)
        merge_day(spark, store, fx.CUSTOMERS, day, options=options)
    held = spark.table(f"{options.database}.customers__rejected")
    held = held.select(F.get_json_object("_key", "$.customer_id").cast("long").alias("customer_id"), F.col("_validation_error").alias("held_back"))
    return spark.table(f"{options.database}.customers").select("customer_id", "email").join(held, "customer_id", "left")


@query(
    "silver_merge_ties",
    """SELECT 'forth' AS runs, l_orderkey AS id, max(l_linenumber) AS last_line FROM lineitem GROUP BY 2
UNION ALL SELECT 'back', l_orderkey, max(l_linenumber) FROM lineitem GROUP BY 2""",
)
def silver_merge_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a key at one time, ordered by log position only, in two runs, and the runs in both orders."""
    at = F.lit(EVENTS_CUT).cast("timestamp")
    lines = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("last_line"),
        F.lit("u").alias("_cdc_op"),
        at.alias("_cdc_ts"),
        at.alias("_ingested_at"),
        F.col("l_linenumber").cast("bigint").alias("_lsn"),
    )
    # A line number occurs more than once in some orders; what differs is the position alone.
    halves = [silver.latest_per_key(lines.filter(F.col("last_line") % 2 == n), ["id"]) for n in (0, 1)]
    halves = [_stored(spark, half, f"ties-{n}") for n, half in enumerate(halves)]
    result = None
    for name, order in (("forth", halves), ("back", halves[::-1])):
        merged = _empty_silver(spark, halves[0])
        for half in order:
            merged = silver.merge_frames(merged, half, ["id"])
        part = merged.select(F.lit(name).alias("runs"), "id", "last_line")
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "silver_job_all_tables",
    f"""WITH {_OC}, {_EV}
SELECT 'silver:customers' AS stage, 'SUCCESS' AS status, count(*) AS n_rows FROM customer
UNION ALL SELECT 'silver:events', 'SUCCESS', count(DISTINCT user_id) FROM ev WHERE NOT broken AND NOT lost
UNION ALL SELECT 'silver:orders', 'ERROR', 0""",
)
def silver_job_all_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch job over written bronze: every table of a day, one with a broken contract, and the run log it wrote."""
    folder = scratch_dir(spark, "silver-job")
    store = BronzeFiles(f"{folder}/bronze")
    store.write(bronze.to_bronze(fx.all_changes(_load(spark, sf_dir)), fx.CONTRACTS, ingested_at=LATENCY_INGESTED_AT), 0)
    database = f"silver_{os.path.basename(folder).replace('-', '_')}"
    contracts = {**fx.CONTRACTS, "orders": BrokenContract("orders", "unknown quality rules")}
    options = SilverOptions(database=database)
    merge_all(spark, store, contracts, LATENCY_INGESTED_AT[:10], options=options, log=f"{folder}/log", run_id="all")
    log = spark.read.parquet(f"{folder}/log")
    counts = consume.table_counts({f"silver:{t}": spark.table(f"{database}.{t}") for t in ("customers", "events")})
    status = F.when(F.col("error").isNull(), "SUCCESS").otherwise("ERROR").alias("status")
    rows = log.select("stage", status).join(counts.withColumnRenamed("table_name", "stage"), "stage", "left")
    return rows.select("stage", "status", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query(
    "silver_composite_key",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC,
    l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC,
    l_linestatus DESC) AS rn
  FROM lineitem) WHERE rn = 1""",
)
def silver_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    rows = silver.latest_per_key(lines, keys, silver.newest_first(lines, keys, ["l_shipdate"]))
    return rows.select(*keys, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


@query("silver_count", f"WITH {_SO} SELECT 'orders' AS table_name, count(*) AS n_rows FROM so")
def silver_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consume.table_counts({"orders": _silver(spark, sf_dir, "orders")})


@query(
    "silver_all_tables",
    f"""WITH {_SO}, {_EV_LATEST}
SELECT 'customers' AS table_name, count(*) AS n_rows, epoch_ms(TIMESTAMP '{fx.CUSTOMERS_AT}') AS last_change_ms FROM customer
UNION ALL SELECT 'orders', count(*), epoch_ms(max(changed_at)) FROM so
UNION ALL SELECT 'events', count(*), epoch_us(max(ts)) // 1000 FROM ev_latest WHERE op <> 'd'""",
)
def silver_all_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table with a contract, from one bronze frame filtered by table."""
    rows = _all_bronze(spark, sf_dir)
    result = None
    for table, contract in fx.CONTRACTS.items():
        changes = silver.dedup_changes(silver.parse_envelope(bronze.valid_rows(rows, table), contract), contract)
        merged = silver.merge_frames(_empty_silver(spark, changes), changes, contract.keys)
        part = merged.agg(F.count("*").alias("n_rows"), F.unix_millis(F.max("_cdc_ts")).alias("last_change_ms"))
        part = part.select(F.lit(table).alias("table_name"), "n_rows", "last_change_ms")
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "reprocess_invalid",
    f"WITH {_EV_LATEST} SELECT user_id, event_id, event_type, value, op AS cdc_op FROM ev_latest",
)
def reprocess_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantined under a mistyped contract, then judged by the corrected one and merged into what was there."""
    judged = _stored(spark, _bronze(spark, sf_dir, "events", fx.EVENTS_STRICT), "reprocess-judged")

    def changes(valid: DataFrame) -> DataFrame:
        return silver.dedup_changes(silver.parse_envelope(valid, fx.EVENTS), fx.EVENTS)

    passed = changes(bronze.valid_rows(judged, "events"))
    again = bronze.revalidate(bronze.invalid_rows(judged, "events"), {"events": fx.EVENTS})
    stored = silver.merge_frames(_empty_silver(spark, passed), passed, ["user_id"], tombstones=True)
    merged = silver.merge_frames(stored, changes(bronze.valid_rows(again)), ["user_id"], tombstones=True)
    return merged.select("user_id", "event_id", "event_type", "value", F.col("_cdc_op").alias("cdc_op"))


# ---------------------------------------------------------------- gold and consumption


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gold.orders_summary(_silver(spark, sf_dir, "orders"), MONEY)
    return rows.withColumn("order_date", F.to_date("order_date"))


def _customers_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gold.customers_orders(_silver(spark, sf_dir, "customers"), _silver(spark, sf_dir, "orders"), MONEY)
    return rows.withColumn("last_order_at", F.col("last_order_at").cast("timestamp_ntz"))


@query("gold_orders_summary", f"WITH {_GS} SELECT order_date, status, order_count, total_amount FROM gs")
def gold_orders_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir)


@query(
    "gold_customers_orders",
    f"WITH {_GC} SELECT customer_id, email, total_orders, lifetime_value, last_order_at FROM gc",
)
def gold_customers_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers_orders(spark, sf_dir)


@query("status_counts", f"WITH {_SO} SELECT status, count(*) AS total FROM so GROUP BY 1 ORDER BY total DESC, status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consume.status_counts(_silver(spark, sf_dir, "orders"))


@query(
    "top_customers",
    f"""WITH {_GC} SELECT email, total_orders, lifetime_value, last_order_at FROM gc
ORDER BY lifetime_value DESC NULLS LAST, customer_id LIMIT 10""",
)
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consume.top_customers(_customers_orders(spark, sf_dir))


@query(
    "recent_summary",
    f"""WITH {_GS} SELECT order_date, status, order_count, total_amount FROM gs
ORDER BY order_date DESC, total_amount DESC, status LIMIT 20""",
)
def recent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consume.recent_summary(_summary(spark, sf_dir))


@query(
    "layer_counts",
    f"""WITH {_SO}, {_EV_LATEST}
SELECT 'bronze_valid' AS layer, 'customers' AS table_name, count(*) AS n_rows FROM customer
UNION ALL SELECT 'bronze_valid', 'orders', count(*) FROM oc
UNION ALL SELECT CASE WHEN broken OR lost THEN 'bronze_invalid' ELSE 'bronze_valid' END, 'events', count(*) FROM ev GROUP BY 1
UNION ALL SELECT 'silver', 'customers', count(*) FROM customer
UNION ALL SELECT 'silver', 'orders', count(*) FROM so
UNION ALL SELECT 'silver', 'events', count(*) FROM ev_latest WHERE op <> 'd'
UNION ALL SELECT 'gold', 'orders_summary', count(DISTINCT (CAST(changed_at AS DATE), status)) FROM so
UNION ALL SELECT 'gold', 'customers_orders', count(*) FROM customer""",
)
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = {t: _stored(spark, _silver(spark, sf_dir, t), f"silver-{t}") for t in fx.CONTRACTS}
    models = {
        "orders_summary": gold.orders_summary(stored["orders"]),
        "customers_orders": gold.customers_orders(stored["customers"], stored["orders"]),
    }
    return report.layer_counts(_all_bronze(spark, sf_dir), stored, models)


@query(
    "table_counts",
    "SELECT 'customers' AS table_name, count(*) AS n_rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders",
)
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = _load(spark, sf_dir)
    return consume.table_counts({"customers": load("customer"), "orders": load("orders")})


# ---------------------------------------------------------------- data tests


@query(
    "test_not_null",
    f"WITH {_GC} SELECT customer_id, email, total_orders FROM gc WHERE lifetime_value IS NULL",
)
def test_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checks.not_null(_customers_orders(spark, sf_dir), "lifetime_value")
    return rows.select("customer_id", "email", "total_orders")


@query(
    "test_unique",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def test_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.unique(fx.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "test_accepted_values",
    f"WITH {_SO} SELECT order_id, status FROM so WHERE status NOT IN ('pending', 'processing', 'shipped', 'delivered')",
)
def test_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_statuses = [s for s in gold.STATUSES if s != "cancelled"]
    return checks.accepted_values(_silver(spark, sf_dir, "orders"), "status", open_statuses).select("order_id", "status")


@query(
    "test_run_checks",
    f"""WITH {_GC}
SELECT 'not_null' AS check_name, 'email' AS column_name, count(*) FILTER (WHERE email IS NULL) AS n_violations FROM gc
UNION ALL SELECT 'not_null', 'lifetime_value', count(*) FILTER (WHERE lifetime_value IS NULL) FROM gc
UNION ALL SELECT 'unique', 'total_orders', (SELECT count(*) FROM
  (SELECT total_orders FROM gc GROUP BY 1 HAVING count(*) > 1))""",
)
def test_run_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = [
        checks.Check("not_null", "email"),
        checks.Check("not_null", "lifetime_value"),
        checks.Check("unique", "total_orders"),
    ]
    written = _stored(spark, _customers_orders(spark, sf_dir), "customers-orders")  # as the job tests it: each check reads it
    return checks.run_checks(written, declared)


@query(
    "unique_violations",
    f"""WITH {_EV}
SELECT 'user_id' AS column_name, CAST(user_id AS VARCHAR) AS value, count(*) AS n_rows
FROM ev WHERE NOT broken AND NOT lost GROUP BY user_id HAVING count(*) > 1""",
)
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's unique rule on the changes themselves, which repeat their keys."""
    rows = silver.parse_envelope(_valid(spark, sf_dir, "events"), fx.EVENTS)
    return checks.unique_violations(rows, fx.EVENTS)


@query(
    "row_count_gate",
    f"WITH {_GS} SELECT 'orders_summary' AS name, count(*) AS n_rows, count(*) >= 1 AS passed FROM gs",
)
def row_count_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.row_count_gate(_summary(spark, sf_dir), "orders_summary")


# ---------------------------------------------------------------- change and contract generation


@query(
    "snapshot_to_cdc",
    f"WITH {_SC} SELECT 'cdc.public.customers' AS topic, customer_id, 'r' AS op, email, name FROM sc",
)
def snapshot_to_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = capture.snapshot_to_cdc(
        fx.customers(fx.table(spark, sf_dir, "customer")), "customers", ["customer_id"], F.lit(1700000000123)
    )
    return rows.select(
        "topic",
        "customer_id",
        "op",
        json_field("value", "after.email").alias("email"),
        json_field("value", "after.name").alias("name"),
    )


@query(
    "diff_to_cdc",
    """WITH o AS (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'MACHINERY'),
n AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN upper(c_name) ELSE c_name END AS c_name
      FROM customer WHERE c_acctbal >= 0),
d AS (
  SELECT coalesce(o.c_custkey, n.c_custkey) AS customer_id,
         CASE WHEN o.c_custkey IS NULL THEN 'c' WHEN n.c_custkey IS NULL THEN 'd' ELSE 'u' END AS op,
         o.c_name AS old_name, n.c_name AS new_name
  FROM o FULL OUTER JOIN n ON o.c_custkey = n.c_custkey
  WHERE o.c_name IS DISTINCT FROM n.c_name)
SELECT 'full' AS replica_identity, customer_id, op, old_name AS before_name, new_name AS after_name FROM d
UNION ALL
SELECT 'default', customer_id, op, CASE WHEN op = 'd' THEN old_name END, new_name FROM d""",
)
def diff_to_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = fx.table(spark, sf_dir, "customer")

    def diff(identity: str) -> DataFrame:
        rows = capture.diff_to_cdc(
            fx.old_customers(customer),
            fx.new_customers(customer),
            "customers",
            ["customer_id"],
            F.lit(1700000000123),
            identity,
        )
        return rows.select(
            F.lit(identity).alias("replica_identity"),
            "customer_id",
            "op",
            json_field("value", "before.name").alias("before_name"),
            json_field("value", "after.name").alias("after_name"),
        )

    return diff("full").unionByName(diff("default"))


@query(
    "diff_by_digest",
    """WITH d AS (
  SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 97 = 0 THEN 'd' WHEN c_custkey % 89 = 5 THEN 'u' ELSE 'c' END AS op,
         CASE WHEN c_custkey % 97 = 0 OR c_custkey % 89 = 5 THEN c_name END AS before_name,
         CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 89 = 5 THEN upper(c_name) || '!' ELSE c_name END AS after_name
  FROM customer WHERE c_custkey % 97 = 0 OR c_custkey % 89 = 5 OR c_custkey % 83 = 7)
SELECT *, (SELECT count(DISTINCT customer_id // 16) FROM d) AS buckets_read FROM d""",
)
def diff_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of customers that differ here and there, the older with its stored digest; only ranges that differ are joined."""
    customers, key = fx.customers(fx.table(spark, sf_dir, "customer")), F.col("customer_id")
    gone, renamed, fresh = key % 97 == 0, key % 89 == 5, key % 83 == 7
    old = customers.where(gone | renamed | ~fresh)
    new = customers.where(~gone).withColumn("name", F.when(renamed, F.concat(F.upper("name"), F.lit("!"))).otherwise(F.col("name")))
    digest = _stored(spark, capture.snapshot_digest(old, ["customer_id"], width=16), "digest")
    rows = capture.diff_by_digest(
        old, new, "customers", ["customer_id"], F.lit(1700000000123), width=16, old_digest=digest, replica_identity="full"
    )
    read = capture.differing_buckets(digest, capture.snapshot_digest(new, ["customer_id"], width=16)).count()
    return rows.select(
        "customer_id",
        "op",
        json_field("value", "before.name").alias("before_name"),
        json_field("value", "after.name").alias("after_name"),
        F.lit(read).cast("bigint").alias("buckets_read"),
    )


@query(
    "profile_by_day",
    """SELECT 'event_id' AS name, count(*) AS n_rows, count(*) - count(event_id) AS n_null, CAST(min(event_id) AS VARCHAR) AS low,
       CAST(max(event_id) AS VARCHAR) AS high, TRUE AS distinct_close, TRUE AS median_close FROM events
UNION ALL SELECT 'user_id', count(*), count(*) - count(user_id), CAST(min(user_id) AS VARCHAR), CAST(max(user_id) AS VARCHAR), TRUE, TRUE FROM events
UNION ALL SELECT 'event_type', count(*), count(*) - count(event_type), min(event_type), max(event_type), TRUE, NULL FROM events""",
)
def profile_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of all events from the stored profiles of their days; its estimates held against exact values."""
    events = fx.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    days = _stored(spark, profile.sketch_profile(events, "day"), "day-profiles")
    found = profile.read_profile(profile.unite_profiles(days), 0.5)
    names = ["event_id", "user_id", "event_type"]
    exact = events.agg(
        *[F.count_distinct(n).alias(f"d_{n}") for n in names],
        *[F.percentile(n, F.array(F.lit(0.45), F.lit(0.55))).alias(f"m_{n}") for n in names[:2]],
    ).first()  # one row
    d = F.create_map(*[F.lit(v) for n in names for v in (n, exact[f"d_{n}"])])[F.col("name")]
    low = F.create_map(*[F.lit(v) for n in names[:2] for v in (n, float(exact[f"m_{n}"][0]))])[F.col("name")]
    high = F.create_map(*[F.lit(v) for n in names[:2] for v in (n, float(exact[f"m_{n}"][1]))])[F.col("name")]
    return found.select(
        "name",
        "n_rows",
        "n_null",
        "low",
        "high",
        (F.abs(F.col("n_distinct") - d) <= 0.1 * d + 1).alias("distinct_close"),
        F.col("quantiles")[0].between(low, high).alias("median_close"),
    )


@query(
    "profile_columns",
    """SELECT 'c_custkey' AS name, 'bigint' AS data_type, count(*) > count(c_custkey) AS is_nullable,
       count(*) = count(DISTINCT c_custkey) AS is_primary_key, 1 AS ordinal_position FROM customer
UNION ALL SELECT 'c_name', 'string', count(*) > count(c_name), FALSE, 2 FROM customer
UNION ALL SELECT 'c_nationkey', 'int', count(*) > count(c_nationkey), FALSE, 3 FROM customer
UNION ALL SELECT 'c_acctbal', 'double', count(*) > count(c_acctbal), FALSE, 4 FROM customer
UNION ALL SELECT 'c_mktsegment', 'string', count(*) > count(c_mktsegment), FALSE, 5 FROM customer""",
)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_columns(fx.table(spark, sf_dir, "customer"))


@query(
    "contract_rules",
    """WITH p(position, name, type, filled, pk) AS (
  SELECT 1, 'o_orderkey', 'long', count(*) = count(o_orderkey), count(*) = count(DISTINCT o_orderkey) FROM orders
  UNION ALL SELECT 2, 'o_custkey', 'long', count(*) = count(o_custkey), FALSE FROM orders
  UNION ALL SELECT 3, 'o_orderstatus', 'string', count(*) = count(o_orderstatus), FALSE FROM orders
  UNION ALL SELECT 4, 'o_totalprice', 'double', count(*) = count(o_totalprice), FALSE FROM orders
  UNION ALL SELECT 5, 'o_orderdate', 'timestamp', count(*) = count(o_orderdate), FALSE FROM orders
  UNION ALL SELECT 6, 'o_orderpriority', 'string', count(*) = count(o_orderpriority), FALSE FROM orders)
SELECT 'field' AS section, position, name, type, filled AS required, pk AS primary_key FROM p
UNION ALL
SELECT 'quality', CAST(row_number() OVER (ORDER BY position) AS INTEGER), name, 'notNull', NULL, NULL FROM p WHERE filled
UNION ALL
SELECT 'quality', (SELECT CAST(count(*) AS INTEGER) + 1 FROM p WHERE filled), name, 'unique', NULL, NULL FROM p WHERE pk""",
)
def contract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.contract_rules(profile.profile_columns(fx.table(spark, sf_dir, "orders")))


# ---------------------------------------------------------------- reports


@query(
    "run_report",
    """SELECT CAST(user_id AS VARCHAR) AS run_id,
       CASE WHEN bool_or(event_type = 'error' AND props IS NOT NULL) THEN 'ERROR' ELSE 'SUCCESS' END AS status,
       count(*) AS n_stages,
       CAST(sum(CAST(value AS DECIMAL(18,3))) AS DOUBLE) AS total_seconds,
       bool_and(value >= 0.5) AS passed,
       max_by(event_type, event_id) AS last_stage,
       max_by(props, event_id) FILTER (WHERE event_type = 'error') AS error
FROM events GROUP BY user_id""",
)
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.run_report(fx.run_log(fx.table(spark, sf_dir, "events")))


@query(
    "stage_seconds",
    """SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS stage,
       CAST(sum(CAST(value AS DECIMAL(18,3))) AS DOUBLE) AS seconds
FROM events GROUP BY 1, 2""",
)
def stage_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.stage_seconds(fx.run_log(fx.table(spark, sf_dir, "events")))


@query(
    "offset_gaps",
    """WITH r AS (
  SELECT event_id % 3 AS p, event_id // 3 AS o, event_id % 31 = 0 AS twice FROM events WHERE (event_id // 3) % 50 NOT IN (7, 8)
), d AS (SELECT p, o, lead(o) OVER (PARTITION BY p ORDER BY o) AS after FROM r)
SELECT 'cdc.public.events' AS topic, CAST(p AS INTEGER) AS "partition", o + 1 AS first_missing, after - 1 AS last_missing,
       after - o - 1 AS n_missing, 0 AS n_repeated FROM d WHERE after > o + 1
UNION ALL SELECT 'cdc.public.events', CAST(p AS INTEGER), NULL, NULL, 0, count(*) FROM r WHERE twice GROUP BY p""",
)
def offset_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that has lost some records and stored others twice, found by its bronze rows, valid and invalid ones."""
    changes = _changes(spark, sf_dir, "events").withColumn("place", F.floor(F.col("offset") / 3).cast("long"))
    left = changes.filter("place % 50 NOT IN (7, 8)")
    left = left.unionByName(left.filter("offset % 31 = 0")).drop("offset").withColumnRenamed("place", "offset")
    rows = bronze.to_bronze(left, fx.CONTRACTS, ingested_at=LATENCY_INGESTED_AT)
    names = {"_source_topic": "topic", "_partition": "partition", "_offset": "offset"}
    return report.offset_gaps(rows.select(*names).withColumnsRenamed(names))


@query(
    "observed_counts",
    f"""WITH {_EV}, {_OC}
SELECT 'bronze' AS stage, '' AS table_name, 'n_valid' AS counter,
       (SELECT count(*) FROM customer) + (SELECT count(*) FROM oc) + (SELECT count(*) FROM ev WHERE NOT broken AND NOT lost) AS n
UNION ALL SELECT 'bronze', '', 'n_invalid', count(*) FROM ev WHERE broken OR lost
UNION ALL SELECT 'silver', 'customers', unnest(['n_read', 'n_changes', 'n_keyless', 'n_rejected']), unnest([n, n, 0, 0]) FROM (SELECT count(*) AS n FROM customer)
UNION ALL SELECT 'silver', 'orders', unnest(['n_read', 'n_changes', 'n_keyless', 'n_rejected']), unnest([n, k, 0, 0])
  FROM (SELECT count(*) AS n, count(DISTINCT order_id) AS k FROM oc)
UNION ALL SELECT 'silver', 'events', unnest(['n_read', 'n_changes', 'n_keyless', 'n_rejected']), unnest([n, k, 0, 0])
  FROM (SELECT count(*) AS n, count(DISTINCT user_id) AS k FROM ev WHERE NOT broken AND NOT lost)""",
)
def observed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream and the batch job counted while they wrote, from their log; nothing is read a second time."""
    folder = scratch_dir(spark, "observed")
    store = BronzeFiles(f"{folder}/bronze")
    changes = fx.all_changes(lambda name: _stream(spark, sf_dir, name))
    start_bronze(changes, store, f"{folder}/checkpoint", fx.CONTRACTS, interval=None, counts=f"{folder}/bronze-counts").awaitTermination()
    batch = bronze.to_bronze(fx.all_changes(_load(spark, sf_dir)), fx.CONTRACTS, ingested_at=LATENCY_INGESTED_AT)
    store = BronzeFiles(f"{folder}/day")
    store.write(batch, 0)
    options = SilverOptions(database=f"silver_{os.path.basename(folder).replace('-', '_')}")
    merge_all(spark, store, fx.CONTRACTS, LATENCY_INGESTED_AT[:10], options=options, counts=f"{folder}/silver-counts")
    rows = None
    for stage in ("bronze", "silver"):
        part = read_counts(spark, f"{folder}/{stage}-counts").groupBy(F.lit(stage).alias("stage"), "table_name", "counter").agg(F.sum("n").alias("n"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query(
    "quarantine_open",
    f"""WITH {_EV}
SELECT count(*) FILTER (WHERE NOT broken AND op = 'd') AS n_valid, count(*) FILTER (WHERE broken OR lost) AS n_open,
       count(*) FILTER (WHERE NOT broken AND NOT lost AND op <> 'd') AS n_resolved, count(*) AS n_records FROM ev""",
)
def quarantine_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day stored under a mistyped contract, reprocessed under the right one by two runs, one of them repeated."""
    folder = scratch_dir(spark, "quarantine")
    store = BronzeFiles(f"{folder}/bronze")
    store.write(bronze.to_bronze(_changes(spark, sf_dir, "events"), {"events": fx.EVENTS_STRICT}, ingested_at=LATENCY_INGESTED_AT), 0)
    options = SilverOptions(database=f"silver_{os.path.basename(folder).replace('-', '_')}", ledger=f"{folder}/ledger")
    for run in ("one", "one", "two"):
        merge_day(spark, store, fx.EVENTS, LATENCY_INGESTED_AT[:10], True, options, run)
    resolved = quarantine.Ledger(f"{folder}/ledger").read(spark, "events")
    return quarantine.quarantine_counts(store.read(spark, "events", "valid"), store.read(spark, "events", "invalid"), resolved)


@query(
    "stream_progress",
    """SELECT batch_id, CAST(n AS BIGINT) AS n_input_rows FROM (
  SELECT row_number() OVER (ORDER BY k) - 1 AS batch_id, n FROM (
    SELECT 1 AS k, count(*) AS n FROM customer UNION ALL SELECT 2, count(*) FROM customer))""",
)
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The progress that a stream over two files, a trigger each, has left in its log."""
    folder = scratch_dir(spark, "progress")
    for _ in range(2):
        fx.table(spark, sf_dir, "customer").coalesce(1).write.mode("append").parquet(f"{folder}/landed")
    landed = spark.readStream.schema(fx.table(spark, sf_dir, "customer").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/landed")
    log = ProgressLog(spark, f"{folder}/log")
    spark.streams.addListener(log)
    try:
        # One job a trigger, so that Spark's number of input rows is the number of records.
        writer = fx.customer_changes(landed).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
        running = writer.trigger(availableNow=True).start(f"{folder}/changes")
        running.awaitTermination()
        if not log.wait(running):
            raise RuntimeError("the stream's progress did not arrive")
    finally:
        spark.streams.removeListener(log)
    return log.read().where(F.col("n_input_rows") > 0).select("batch_id", "n_input_rows")


@query(
    "stream_lag",
    f"""SELECT 'cdc.public.events' AS topic, CAST(event_id % 3 AS INTEGER) AS "partition",
       max(event_id) FILTER (WHERE ts < TIMESTAMP '{COMMITTED_UNTIL}') + 1 AS committed_offset,
       max(event_id) + 1 AS end_offset,
       max(event_id) - max(event_id) FILTER (WHERE ts < TIMESTAMP '{COMMITTED_UNTIL}') AS lag
FROM events GROUP BY event_id % 3""",
)
def stream_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consumer has read everything up to a point in time."""
    changes = _changes(spark, sf_dir, "events")
    read = changes.filter(F.col("timestamp") < F.lit(COMMITTED_UNTIL).cast("timestamp"))
    committed = read.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("committed_offset"))
    return report.stream_lag(report.topic_offsets(changes), committed)


# ---------------------------------------------------------------- driver contract


def _with_package(function: Query) -> Query:
    """The query, with this folder on the path of the Python workers, wherever the driver was started."""
    root = os.path.dirname(os.path.abspath(__file__))

    @functools.wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        environment = spark.sparkContext.environment
        paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
        return function(spark, sf_dir)

    return run


def _add_optional() -> None:
    """Add the training-data queries where their modules and all that they need exist; the rest works without them."""
    try:
        from tidelake.llm import queries as llm
    except (ImportError, OSError) as error:
        if not (getattr(error, "name", None) or "").startswith("tidelake.llm"):
            warnings.warn(f"without the training-data queries: {error}", stacklevel=1)
        return
    _QUERIES.update({name: _with_package(function) for name, function in llm.QUERIES.items()})
    _ORACLE.update(llm.ORACLE_SQL)
    try:
        import corpus_pipeline
    except ImportError as error:
        if error.name != "corpus_pipeline":
            warnings.warn(f"without the pipeline: {error}", stacklevel=1)
        return
    _QUERIES["pipeline"] = _with_package(corpus_pipeline.run)
    if corpus_pipeline.ORACLE_SQL:
        _ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL


_add_optional()


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: order changes through bronze and silver into the daily summary."""
    return _QUERIES["gold_orders_summary"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
