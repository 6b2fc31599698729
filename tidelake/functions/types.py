"""Type mappings between source databases, data contracts and Spark."""

from __future__ import annotations

from pyspark.sql import types as T

# Contract type -> Spark type. Timestamps arrive as epoch microseconds, dates as text.
CONTRACT_TO_SPARK = {
    "integer": T.IntegerType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "string": T.StringType(),
    "text": T.StringType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.LongType(),
    "date": T.StringType(),
}

# Column type of a relational source -> contract type.
SOURCE_TO_CONTRACT = {
    "integer": "integer",
    "smallint": "integer",
    "bigint": "long",
    "numeric": "number",
    "real": "float",
    "double precision": "double",
    "character varying": "string",
    "varchar": "string",
    "character": "string",
    "text": "string",
    "uuid": "string",
    "boolean": "boolean",
    "date": "date",
    "timestamp without time zone": "timestamp",
    "timestamp with time zone": "timestamp",
    "jsonb": "object",
    "json": "object",
    "bytea": "bytes",
}

# The same for the type names Spark prints.
SPARK_TO_CONTRACT = {
    "tinyint": "integer",
    "smallint": "integer",
    "int": "integer",
    "bigint": "long",
    "float": "float",
    "double": "double",
    "decimal": "number",
    "string": "string",
    "char": "string",
    "varchar": "string",
    "boolean": "boolean",
    "date": "date",
    "timestamp": "timestamp",
    "timestamp_ntz": "timestamp",
    "binary": "bytes",
    "struct": "object",
    "map": "object",
    "array": "object",
    "variant": "object",
}


def spark_type(contract_type: str) -> T.DataType:
    """Spark type of a contract type; anything unknown is kept as text."""
    return CONTRACT_TO_SPARK.get(contract_type, T.StringType())


def contract_type(source_type: str) -> str:
    """Contract type of a source or Spark column type; unknown types are strings."""
    if source_type in SOURCE_TO_CONTRACT:
        return SOURCE_TO_CONTRACT[source_type]
    head = source_type.split("(")[0].split("<")[0]
    return SPARK_TO_CONTRACT.get(head, SOURCE_TO_CONTRACT.get(head, "string"))
