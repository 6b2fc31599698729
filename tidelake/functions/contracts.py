"""Data contracts: a few kilobytes of YAML or JSON per table, read once on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.types import spark_type

try:
    import yaml
except ImportError:  # YAML contracts then raise a clear error, JSON ones still load
    yaml = None


class ContractError(ValueError):
    """The contract cannot be used for what was asked."""


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    required: bool = False
    primary_key: bool = False


RULE_KINDS = ("notNull", "unique")


@dataclass(frozen=True)
class Rule:
    kind: str  # one of RULE_KINDS
    column: str


@dataclass(frozen=True)
class BrokenContract:
    """A contract file that cannot be used: records of its table are held back, those of others are not."""

    table: str
    reason: str


@dataclass(frozen=True)
class Contract:
    table: str
    fields: tuple[Field, ...]
    rules: tuple[Rule, ...] = ()

    def __post_init__(self) -> None:
        check_table_name(self.table)
        if not self.fields:
            raise ContractError(f"contract {self.table} has no fields")

    @property
    def keys(self) -> list[str]:
        return [f.name for f in self.fields if f.primary_key]

    def require_keys(self) -> list[str]:
        if not self.keys:
            raise ContractError(f"contract {self.table} has no primary key")
        return self.keys

    @property
    def not_null(self) -> list[str]:
        """Columns that must be present: required fields, then notNull rules, each named once."""
        names = [f.name for f in self.fields if f.required]
        names += [r.column for r in self.rules if r.kind == "notNull"]
        return list(dict.fromkeys(names))

    @property
    def unique(self) -> list[str]:
        return [r.column for r in self.rules if r.kind == "unique"]

    def to_struct(self) -> T.StructType:
        """Row schema; every field is nullable whatever `required` says."""
        return T.StructType([T.StructField(f.name, spark_type(f.type), True) for f in self.fields])

    def text_struct(self) -> T.StructType:
        """The row image as it is parsed: every field as text, cast afterwards."""
        return T.StructType([T.StructField(f.name, T.StringType(), True) for f in self.fields])


def check_table_name(name: str) -> str:
    """Table names end up in DDL, so only letters, digits and underscores pass."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", name or ""):
        raise ContractError(f"bad table name: {name!r}")
    return name


def from_document(document: dict, table: str | None = None) -> Contract:
    """Read either dialect: `schema: {fields: [...]}` or `schema: [{name, fields}, ...]`."""
    if not isinstance(document, dict):
        raise ContractError("contract is not a mapping")
    try:
        return _from_mapping(document, table or document.get("name"))
    except (KeyError, TypeError, AttributeError) as error:
        raise ContractError(f"contract {table}: {type(error).__name__}: {error}") from error


def _from_mapping(document: dict, table: str) -> Contract:
    schema = document.get("schema") or {}
    if isinstance(schema, list):
        match = [s for s in schema if s.get("name", table) == table]
        if not match:
            raise ContractError(f"contract {table}: its schema is of {[s.get('name') for s in schema]}")
        schema = match[0]
    fields = tuple(
        Field(
            name=f["name"],
            type=f.get("type", "string"),
            required=bool(f.get("required", False)),
            primary_key=bool(f.get("primaryKey", False)),
        )
        for f in schema.get("fields") or []
    )
    rules = tuple(Rule(q["type"], q["column"]) for q in document.get("quality") or [])
    unknown = sorted({str(r.kind) for r in rules} - set(RULE_KINDS))
    if unknown:
        raise ContractError(f"contract {table}: unknown quality rules {unknown}")
    return Contract(table, fields, rules)


def to_document(contract: Contract, version: str = "1.0.0", **header: str) -> dict:
    """The contract as the mapping that is written to a file; `header`: description, owner, domain and the like."""
    return {
        # The file format's keys, specification number and form of the identifier.
        "dataContractSpecification": "0.9.3",
        "id": f"urn:datacontract:{contract.table}",
        "name": contract.table,
        "version": version,
        **header,
        "schema": {
            "type": "table",
            "fields": [
                {"name": f.name, "type": f.type, "required": f.required, "primaryKey": f.primary_key}
                for f in contract.fields
            ],
        },
        "quality": [{"type": r.kind, "column": r.column} for r in contract.rules],
    }


def parse_text(text: str, table: str | None = None) -> Contract:
    """A contract from YAML or JSON text."""
    if yaml is not None:
        try:
            return from_document(yaml.safe_load(text), table)
        except yaml.YAMLError as error:
            raise ContractError(f"contract {table}: {error}") from error
    try:
        return from_document(json.loads(text), table)
    except json.JSONDecodeError as error:
        raise ContractError(f"contract {table}: not JSON, and no YAML reader is installed") from error


def to_text(contract: Contract, **header: str) -> str:
    """The file text: YAML where a writer is installed, else JSON, which every YAML reader takes."""
    document = to_document(contract, **header)
    if yaml is None:
        return json.dumps(document, indent=2)
    return yaml.safe_dump(document, sort_keys=False)


def _read_files(spark: SparkSession, folder: str, pattern: str) -> dict[str, Contract | BrokenContract]:
    files = (
        spark.read.option("pathGlobFilter", pattern)
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_name").alias("file"), "value")
    )
    contracts: dict[str, Contract | BrokenContract] = {}
    for row in files.collect():  # one row per contract file
        table = row["file"].rsplit(".", 1)[0]
        try:
            contracts[table] = parse_text(row["value"], table)
        except ContractError as error:
            contracts[table] = BrokenContract(table, str(error))
    return contracts


def load_contracts(spark: SparkSession, folder: str) -> dict[str, Contract | BrokenContract]:
    """All contracts of a folder on any file system Spark reads; the file stem names the table.

    A file that cannot be used gives a `BrokenContract` for its own table; the others load.
    """
    return _read_files(spark, folder, "*.{yaml,yml,json}")


def load_contract(spark: SparkSession, folder: str, table: str) -> Contract:
    """The contract of one table; no other file is read."""
    contract = _read_files(spark, folder, f"{check_table_name(table)}.{{yaml,yml,json}}").get(table)
    if contract is None:
        raise FileNotFoundError(f"no contract for {table} in {folder}")
    if isinstance(contract, BrokenContract):
        raise ContractError(contract.reason)
    return contract


class ContractFolder:
    """The contracts of a folder, read again only when its listing has changed."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._listing: list | None = None
        self._contracts: dict[str, Contract | BrokenContract] = {}

    def __call__(self) -> dict[str, Contract | BrokenContract]:
        listing = self.spark.read.format("binaryFile").load(self.folder).select("path", "modificationTime", "length")
        found = sorted(tuple(r) for r in listing.collect())  # one row per file; no content is read
        if found != self._listing:
            self._contracts, self._listing = load_contracts(self.spark, self.folder), found
        return self._contracts
