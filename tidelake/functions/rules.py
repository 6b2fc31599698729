"""Contracts compiled into rules: one error text per record, empty for a valid one.

The rules are data, not code: a record meets the rules of its table through a join with the rules of all
contracts, and one expression of fixed size checks them. An expression with a branch per table grows
with the number of contracts until the JVM refuses to compile it.
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.contracts import BrokenContract, Contract
from tidelake.functions.types import spark_type

POLICIES = ("pass", "fail")

# Types whose text is checked by a cast.
_CAST_TYPES = ("bigint", "int", "double", "float", "date")
# Contract types whose text has a form of its own, whatever Spark type stores it.
_FORMS = ("date", "object", "bytes")

RULES = "_rules"
_RULES_TYPE = "array<struct<position:int,name:string,kind:string,required:boolean,is_key:boolean>>"
_BROKEN = "broken contract"


def _rules(contract: Contract | BrokenContract) -> list[tuple]:
    """(name, kind, required, is_key) of every rule; a broken contract has one that nothing passes."""
    if isinstance(contract, BrokenContract):
        return [(contract.reason, _BROKEN, True, True)]
    not_null = contract.not_null
    known = {f.name for f in contract.fields}
    rules = [
        (
            f.name,
            f.type if f.type in _FORMS else spark_type(f.type).simpleString(),
            f.name in not_null or f.primary_key,
            f.primary_key,
        )
        for f in contract.fields
    ]
    return rules + [(name, "any", True, False) for name in not_null if name not in known]


def rules_frame(spark: SparkSession, contracts: Mapping[str, Contract | BrokenContract]) -> DataFrame:
    """The rules of all contracts, one row per table.

    They start as one local row per rule, so Spark's estimate of their size grows with them, and its own
    limit decides whether they are broadcast.
    """
    rows = [
        (table, position, *rule)
        for table, contract in sorted(contracts.items())
        for position, rule in enumerate(_rules(contract))
    ]
    names = ["_table", "position", "name", "kind", "required", "is_key"]
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)]
    frame = spark.createDataFrame(pa.table(columns, names))
    return frame.groupBy("_table").agg(F.array_sort(F.collect_list(F.struct(*names[1:]))).alias(RULES))


def with_rules(df: DataFrame, contracts: Mapping[str, Contract | BrokenContract]) -> DataFrame:
    """Adds `_rules`, the rules of the record's `_table`; null where there is no contract."""
    if not contracts:
        return df.withColumn(RULES, F.lit(None).cast(_RULES_TYPE))
    return df.join(rules_frame(df.sparkSession, contracts), "_table", "left")


def _mistyped(kind: Column, text: Column) -> Column:
    """Whether a text is no value of its contract type. A text that is a JSON object or array is no scalar."""
    nested = F.substring(F.ltrim(text), 1, 1).isin("{", "[") & F.try_parse_json(text).isNotNull()
    wrong = F.when(kind == "object", ~nested).when(nested, True).when(kind.isin("string", "any"), False)
    for name in _CAST_TYPES:
        wrong = wrong.when(kind == name, text.try_cast(name).isNull())
    wrong = wrong.when(kind == "boolean", ~F.lower(text).isin("true", "false"))
    base64 = text.rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.length(text) % 4 == 0)
    return wrong.when(kind == "bytes", ~base64).otherwise(False)


def row_errors(rules: Column, image: Column, op: Column) -> Column:
    """Broken rules of a row image (a map of texts), joined by `; `. A delete only needs its key."""

    def broken(pair: Column) -> Column:
        rule, text = pair["rule"], pair["text"]
        return (
            F.when((op == "d") & ~rule["is_key"], F.lit(None).cast("string"))
            .when(text.isNull(), F.when(rule["required"], F.concat(rule["name"], F.lit(": required"))))
            .when(_mistyped(rule["kind"], text), F.concat(rule["name"], F.lit(": type")))
        )

    # The text is looked up once per rule, not once for each place in which the check names it.
    pairs = F.transform(rules, lambda rule: F.struct(rule.alias("rule"), image[rule["name"]].alias("text")))
    return F.array_join(F.transform(pairs, broken), "; ")


def error_column(
    table: Column,
    rules: Column,
    image: Column,
    op: Column,
    defect: Column,
    tombstone: Column,
    on_missing_contract: str = "pass",
) -> Column:
    """The verdict on a record of any table: tombstones pass, then defects, then the contract's rules."""
    if on_missing_contract not in POLICIES:
        raise ValueError(f"on_missing_contract must be one of {POLICIES}")
    unknown = F.lit("") if on_missing_contract == "pass" else F.concat(F.lit("contract not found: "), table)
    return (
        F.when(tombstone, F.lit(""))
        .when(rules.isNull(), unknown)
        .when(rules[0]["kind"] == _BROKEN, rules[0]["name"])
        .when(defect.isNotNull(), defect)
        .otherwise(row_errors(rules, image, op))
    )
