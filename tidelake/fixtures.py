"""Change streams derived from the test tables, for queries, tests and the benchmark.

Every rule is a plain expression over a whole table, so that the expected results can be written as SQL
on the tables without going through JSON. See FIXTURES.md.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.contracts import Contract, Field, Rule
from tidelake.functions.envelope import change_record
from tidelake.operators.capture import topic_of
from tidelake.sources.seed import email_of, status_of

CUSTOMERS_AT = "1990-01-01 00:00:00"

CUSTOMERS = Contract(
    "customers",
    (
        Field("customer_id", "long", True, True),
        Field("email", "string", True),
        Field("name", "string", True),
        Field("created_at", "timestamp"),
    ),
    (
        Rule("notNull", "customer_id"),
        Rule("notNull", "email"),
        Rule("notNull", "name"),
        Rule("unique", "customer_id"),
        Rule("unique", "email"),
    ),
)
ORDERS = Contract(
    "orders",
    (
        Field("order_id", "long", True, True),
        Field("customer_id", "long", True),
        Field("status", "string", True),
        Field("amount", "number", True),
        Field("created_at", "timestamp"),
    ),
    (Rule("notNull", "order_id"), Rule("notNull", "amount"), Rule("unique", "order_id")),
)
EVENTS = Contract(
    "events",
    (
        Field("user_id", "long", True, True),
        Field("event_id", "long", True),
        Field("event_type", "string", True),
        Field("value", "double", False),
    ),
    (Rule("notNull", "user_id"), Rule("unique", "user_id")),
)
# The events contract as a team that mistook the type of two columns might have written it.
EVENTS_STRICT = Contract(
    "events",
    (
        Field("user_id", "long", True, True),
        Field("event_id", "long", True),
        Field("event_type", "integer", False),
        Field("value", "integer", False),
    ),
)
CONTRACTS = {c.table: c for c in (CUSTOMERS, ORDERS, EVENTS)}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _no_row(row: Column, df: DataFrame) -> Column:
    return F.lit(None).cast(df.select(row.alias("r")).schema["r"].dataType)


def topic(table: str, column: Column) -> Column:
    """The topic as data that depends on a row, as in a stream: a literal would turn joins by topic into filters."""
    return F.concat(F.lit(topic_of(table)), F.substring(F.coalesce(column.cast("string"), F.lit("")), 1, 0))


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def customers(customer: DataFrame) -> DataFrame:
    """The customers table of the source."""
    return customer.select(
        F.col("c_custkey").alias("customer_id"), email_of(F.col("c_custkey")).alias("email"), F.col("c_name").alias("name")
    )


def customer_changes(customer: DataFrame) -> DataFrame:
    """One snapshot record per customer, all at one time."""
    at = F.lit(CUSTOMERS_AT).cast("timestamp")
    rows = customers(customer).withColumn("created_at", F.unix_micros(at) + F.col("customer_id") * 1_000_000)
    row = F.struct("customer_id", "email", "name", "created_at")
    return rows.select(
        topic("customers", F.col("customer_id")).alias("topic"),
        (F.col("customer_id") % 3).cast("int").alias("partition"),
        F.col("customer_id").alias("offset"),
        at.alias("timestamp"),
        change_record("customers", F.lit("r"), _no_row(row, rows), row, F.unix_millis(at), F.col("customer_id")).alias(
            "value"
        ),
    )


def order_changes(orders: DataFrame) -> DataFrame:
    """A snapshot record per order; a day later some are delivered, two days later some are deleted.

    Updates write the amount as text, the others as a number.
    """
    key = F.col("o_orderkey")
    steps = F.array(
        F.lit(0),
        F.when(key % 7 == 0, F.lit(1)),
        F.when(key % 11 == 0, F.lit(2)),
    )
    rows = (
        orders.select("*", F.explode(F.array_compact(steps)).alias("step"))
        .withColumn("at", F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(days=F.col("step")))
        .withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))
    )

    def image(amount: Column, status: Column) -> Column:
        return F.struct(
            key.alias("order_id"), F.col("o_custkey").alias("customer_id"), status.alias("status"), amount.alias("amount"),
            F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_at"),
        )

    status, step = status_of(key), F.col("step")
    as_is = image(F.col("amount"), status)
    delivered = image(F.col("amount").cast("string"), F.lit("delivered"))

    def record(op: str, before: Column, after: Column) -> Column:
        return change_record("orders", F.lit(op), before, after, F.unix_millis("at"), key * 3 + step)

    none_as_is, none_delivered = _no_row(as_is, rows), _no_row(delivered, rows)
    value = (
        F.when(step == 0, record("r", none_as_is, as_is))
        .when(step == 1, record("u", none_delivered, delivered))
        .otherwise(record("d", as_is, none_as_is))
    )
    return rows.select(
        topic("orders", key).alias("topic"),
        (key % 3).cast("int").alias("partition"),
        (key * 3 + step).alias("offset"),
        F.col("at").alias("timestamp"),
        value.alias("value"),
    )


def event_op() -> Column:
    kind = F.col("event_type")
    return F.when(kind == "signup", "c").when(kind == "error", "d").otherwise("u")


def event_changes(events: DataFrame) -> DataFrame:
    """One record per event, keyed by user; every other one is wrapped in `payload`.

    Defects: event_id % 89 = 0 is cut off after `{broken`; of the others that are not deletes,
    event_id % 97 = 0 has no user.
    """
    op = event_op()
    lost = (op != "d") & (F.col("event_id") % 97 == 0)
    row = F.struct(
        "event_id", F.when(~lost, F.col("user_id")).alias("user_id"), "event_type", "value"
    )
    none = _no_row(row, events)
    before, after = F.when(op == "d", row).otherwise(none), F.when(op != "d", row).otherwise(none)
    wrapped, bare = (
        change_record("events", op, before, after, millis(F.col("ts")), F.col("event_id"), wrapped=w)
        for w in (True, False)
    )
    value = (
        F.when(F.col("event_id") % 89 == 0, F.lit("{broken"))
        .when(F.col("event_id") % 2 == 0, wrapped)
        .otherwise(bare)
    )
    return events.select(
        topic("events", F.col("event_id")).alias("topic"),
        (F.col("event_id") % 3).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        value.alias("value"),
    )


def all_changes(load: Callable[[str], DataFrame]) -> DataFrame:
    """The three topics in one frame, as one subscription sees them; `load` gives a table by name."""
    parts = [customer_changes(load("customer")), order_changes(load("orders")), event_changes(load("events"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


TYPED = Contract(
    "typed",
    (
        Field("id", "long", True, True),
        Field("i", "integer"),
        Field("f", "float"),
        Field("d", "double"),
        Field("n", "number"),
        Field("b", "boolean"),
        Field("s", "string"),
        Field("t", "text"),
        Field("created_at", "timestamp"),
        Field("day", "date"),
        Field("o", "object"),
        Field("x", "bytes"),
    ),
)


def typed_changes(orders: DataFrame) -> DataFrame:
    """A record per order with a field of every contract type; key % 13 names the field that is wrong, 0 and 12 none."""
    key = F.col("o_orderkey")
    wrong = lambda n: key % 13 == n

    def text(n: int, bad: str, good: Column) -> Column:
        return F.when(wrong(n), F.lit(bad)).otherwise(good.cast("string"))

    nested = F.to_json(F.struct(key.alias("a")))
    micros = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    fields = {
        "id": key.cast("string"),
        "i": text(1, '"1.5"', key),
        "f": text(2, '"x"', F.lit(1.5)),
        "d": text(3, '"1,5"', F.lit(2.5)),
        "n": text(4, '"much"', F.col("o_totalprice").cast("decimal(18,2)")),
        "b": text(5, '"t"', F.lit(True)),
        "s": text(6, '{"a": 1}', F.lit('"[text"')),
        "t": text(7, "[1]", F.lit('"text"')),
        "created_at": text(8, '"soon"', micros),
        "day": text(9, '"not a date"', F.concat(F.lit('"'), F.col("o_orderdate").cast("date"), F.lit('"'))),
        "o": text(10, '"not an object"', nested),
        "x": text(11, '"?"', F.lit('"YWJj"')),
    }
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{name}": '), value) for name, value in fields.items()])
    at = F.col("o_orderdate").cast("timestamp")
    head = F.concat(F.lit('{"op": "c", "ts_ms": '), F.unix_millis(at).cast("string"), F.lit(', "after": {'))
    return orders.select(
        topic("typed", key).alias("topic"),
        (key % 3).cast("int").alias("partition"),
        key.alias("offset"),
        at.alias("timestamp"),
        F.concat(head, body, F.lit("}}")).alias("value"),
    )


def event_type_changes(events: DataFrame) -> DataFrame:
    """The event records with a topic for each event type."""
    changes = event_changes(events).drop("topic")
    named = events.select(F.col("event_id").alias("offset"), F.concat(F.lit("cdc.public."), "event_type").alias("topic"))
    return changes.join(named, "offset")


def old_customers(customer: DataFrame) -> DataFrame:
    """An earlier snapshot: the machinery segment had not signed up yet."""
    return customers(customer.filter(F.col("c_mktsegment") != "MACHINERY"))


def new_customers(customer: DataFrame) -> DataFrame:
    """A later snapshot: overdrawn accounts are closed, household names are spelt in capitals."""
    kept = customer.filter(F.col("c_acctbal") >= 0)
    name = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.upper("c_name")).otherwise(F.col("c_name"))
    return customers(kept.withColumn("c_name", name))


def run_log(events: DataFrame) -> DataFrame:
    """Events read as a run log: one run per user, one stage per event."""
    failed = F.col("event_type") == "error"
    return events.select(
        F.col("user_id").cast("string").alias("run_id"),
        F.lit("events").alias("table_name"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("stage"),
        F.col("value").alias("seconds"),
        F.when(F.col("value") >= 0.5, 1.0).otherwise(0.0).alias("score"),
        F.when(failed, F.col("props")).alias("error"),
    )
