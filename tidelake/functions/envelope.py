"""Change records: reading the JSON envelope into columns, and writing it.

A record is `{"before", "after", "op", "source", "ts_ms"}`, optionally wrapped in `payload`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAP_IMAGE = T.MapType(T.StringType(), T.StringType())

# Epoch milliseconds of years 1 and 9999: timestamp_millis fails outside what a timestamp can hold.
_MIN_MILLIS = -62135596800000
_MAX_MILLIS = 253402300799999


def table_of(topic: str | Column) -> Column:
    """The table a topic carries: its last dot segment."""
    return F.substring_index(topic, ".", -1)


def json_field(value: str | Column, path: str) -> Column:
    """A scalar of the record, e.g. `after.email`, from the wrapped or the bare envelope."""
    return F.coalesce(
        F.get_json_object(value, f"$.payload.{path}"), F.get_json_object(value, f"$.{path}")
    )


def event_time(ts_ms: Column, fallback: Column) -> Column:
    """Timestamp of an epoch-millisecond text; the fallback where there is none or it is absurd."""
    millis = ts_ms.try_cast("bigint")
    return F.coalesce(
        F.when(millis.between(_MIN_MILLIS, _MAX_MILLIS), F.timestamp_millis(millis)), fallback
    )


def is_tombstone(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def envelope_schema(image: T.DataType | None) -> T.ArrayType:
    """What is read of a record; `image` is the type of before/after, None where rows are not needed."""
    body = [
        T.StructField("op", T.StringType()),
        T.StructField("ts_ms", T.StringType()),
        T.StructField("source", T.StructType([T.StructField("lsn", T.StringType())])),
    ]
    if image is not None:
        body += [T.StructField("before", image), T.StructField("after", image)]
    end = T.StructField("_end", T.StringType())
    return T.ArrayType(T.StructType([T.StructField("payload", T.StructType(body)), *body, end]))


def parse_records(
    df: DataFrame, value: str, image: T.DataType | None = MAP_IMAGE, check: bool = True
) -> DataFrame:
    """Adds `_op`, `_ts_ms`, `_lsn` (text), `_image` and, with `check`, `_defect` to every row of `df`.

    The image is `before` for deletes and `after` otherwise. `_defect` is null for a usable record; for
    it, the text is read as the first of two array elements, the second being a mark: the JSON reader
    stops after the first value, so on the bare text it would miss whatever follows the record.

    The JSON is parsed once per record. The parsed value goes through a one-element explode because a
    filter on a plain projection is pushed below it, which parses the text again for the filter.
    """
    raw = F.col(value)
    schema = envelope_schema(image)
    if check:
        parsed = F.from_json(F.concat(F.lit("["), raw, F.lit(',{"_end":"1"}]')), schema)
        envelope, mark = F.get("_parsed", F.lit(0)), F.get("_parsed", F.lit(1))
    else:
        parsed = F.from_json(raw, schema.elementType)
        envelope = F.col("_parsed")
    rows = df.select("*", F.explode(F.array(parsed)).alias("_parsed"))

    def part(*path: str) -> Column:
        wrapped, bare = envelope["payload"], envelope
        for name in path:
            wrapped, bare = wrapped[name], bare[name]
        return F.coalesce(wrapped, bare)

    op = F.lower(F.coalesce(part("op"), F.lit("r")))
    images = F.lit(None) if image is None else F.when(op == "d", part("before")).otherwise(part("after"))
    columns = [
        *[F.col(c) for c in df.columns],
        op.alias("_op"),
        part("ts_ms").alias("_ts_ms"),
        part("source", "lsn").alias("_lsn"),
        images.alias("_image"),
    ]
    if check:
        whole = (F.size("_parsed") == 2) & envelope.isNotNull() & (mark["_end"] == "1")
        defect = F.when(
            ~F.coalesce(whole, F.lit(False)),
            F.when(F.try_parse_json(raw).isNull(), F.lit("malformed json"))
            .when(~F.ltrim(raw).startswith("{"), F.lit("not an object"))
            .otherwise(F.lit("malformed json")),
        )
        columns.append(defect.alias("_defect"))
    return rows.select(*columns)


def change_record(
    table: str | Column,
    op: Column,
    before: Column,
    after: Column,
    ts_ms: Column,
    lsn: Column | None = None,
    wrapped: bool = True,
) -> Column:
    """JSON text of a change record; `before` and `after` are structs, null where absent."""
    table = F.lit(table) if isinstance(table, str) else table
    body = F.struct(
        before.alias("before"),
        after.alias("after"),
        op.alias("op"),
        F.struct(table.alias("table"), (F.lit(None).cast("bigint") if lsn is None else lsn).alias("lsn")).alias("source"),
        ts_ms.alias("ts_ms"),
    )
    if wrapped:
        body = F.struct(body.alias("payload"))
    return F.to_json(body, {"ignoreNullFields": "false"})
