"""Small change streams for the unit tests."""

import json

from tidelake.functions.contracts import Contract, Field, Rule

ITEMS = Contract(
    "items",
    (Field("id", "long", True, True), Field("name", "string", True), Field("price", "number"), Field("ok", "boolean")),
    (Rule("notNull", "id"), Rule("unique", "id")),
)


def record(op, row, ts_ms=1700000000000, lsn=None, wrapped=True, before=None, **extra):
    body = {"before": before, "after": row, "op": op, "source": {"table": "items", "lsn": lsn}, "ts_ms": ts_ms, **extra}
    if op == "d":
        body["before"], body["after"] = row, None
    return json.dumps({"payload": body} if wrapped else body)


def changes(spark, values, topic="cdc.public.items"):
    """A frame of records; offsets follow the list order."""
    rows = [(topic, v, 0, i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "topic string, value string, partition int, offset bigint")
