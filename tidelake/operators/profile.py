"""Contract generation: measure a table's columns and propose its contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.contracts import Contract, Field, Rule
from tidelake.functions.types import contract_type
from tidelake.operators.checks import unique

PROFILE_SCHEMA = (
    "name string, data_type string, is_nullable boolean, is_primary_key boolean, ordinal_position int"
)
RULES_SCHEMA = "section string, position int, name string, type string, required boolean, primary_key boolean"

_KEY_TYPES = (T.IntegralType, T.StringType)
_ESTIMATE_ERROR = 0.02


def profile_columns(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row per column: name, type, whether nulls occur, whether it is part of the key, position.

    Spark tables declare no keys, so the key is measured: the first integer or text column without
    nulls whose values are all different, or the `keys` given if they hold up. One pass collects null
    counts and distinct estimates (a single row). Candidates are checked exactly, in the order of the
    columns; the estimates only put those aside for last that look far from unique.
    """
    names = df.columns
    candidates = [f.name for f in df.schema.fields if isinstance(f.dataType, _KEY_TYPES)]
    wanted = [] if keys else candidates
    measures = [F.count("*").alias("rows")]
    measures += [F.count(F.col(n)).alias(f"filled_{i}") for i, n in enumerate(names)]
    measures += [F.approx_count_distinct(n, _ESTIMATE_ERROR).alias(f"distinct_{n}") for n in wanted]
    stats = df.agg(*measures).first()  # one row, as wide as the schema
    nullable = {n: stats[f"filled_{i}"] < stats["rows"] for i, n in enumerate(names)}

    def holds(key: Sequence[str]) -> bool:
        return not any(nullable[n] for n in key) and unique(df, key).isEmpty()

    if keys:
        primary = set(keys) if holds(list(keys)) else set()
    else:
        filled = [n for n in candidates if not nullable[n] and stats["rows"]]
        # By halves: columns that look alike in this keep their order.
        looks = sorted(filled, key=lambda n: -round(2 * stats[f"distinct_{n}"] / stats["rows"]))
        primary = set(next(([n] for n in looks if holds([n])), []))
    rows = [
        (f.name, f.dataType.simpleString(), nullable[f.name], f.name in primary, i)
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def contract_rules(profile: DataFrame) -> DataFrame:
    """The proposed contract as rows: `field` rows, then `quality` rows.

    notNull for every column that is never null, and one unique rule on the first key column. The
    profile has one row per column, so everything here is metadata-sized.
    """
    contract = propose_contract("proposal", profile)
    rows = [
        ("field", i, f.name, f.type, f.required, f.primary_key) for i, f in enumerate(contract.fields, start=1)
    ]
    rows += [("quality", i, r.column, r.kind, None, None) for i, r in enumerate(contract.rules, start=1)]
    return profile.sparkSession.createDataFrame(rows, RULES_SCHEMA)


def propose_contract(table: str, profile: DataFrame) -> Contract:
    """The contract object for a profiled table; `contracts.to_text` gives the file."""
    columns = sorted(profile.collect(), key=lambda r: r["ordinal_position"])  # one row per column
    fields = tuple(
        Field(c["name"], contract_type(c["data_type"]), not c["is_nullable"], c["is_primary_key"]) for c in columns
    )
    rules = [Rule("notNull", c["name"]) for c in columns if not c["is_nullable"]]
    keys = [c["name"] for c in columns if c["is_primary_key"]]
    rules += [Rule("unique", keys[0])] if keys else []
    return Contract(table, fields, tuple(rules))


def sketch_profile(df: DataFrame, *by: Column | str) -> DataFrame:
    """A profile that adds up: for each group (such as a day) and column of `df` a row of counts, ends and sketches.

    `name`, `n_rows`, `n_filled`, the `low` and `high` value as text, `distinct_sketch` (HLL; whole numbers, texts, dates and times)
    and `quantile_sketch` (KLL; numbers). One pass, folded before the shuffle; a row has a bounded size. Store the rows
    of a day and unite them with those of others: no older day is read again. Columns of other types have counts only.
    """
    groups = [F.col(g) if isinstance(g, str) else g for g in by]
    taken = {c for c in df.select(*groups).columns} if groups else set()
    fields = [f for f in df.schema.fields if f.name not in taken]

    def measures(field: T.StructField) -> Column:
        value, kind = F.col(f"`{field.name}`"), field.dataType
        plain = isinstance(kind, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))
        countable = isinstance(kind, (T.IntegralType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))
        hashed = value if isinstance(kind, (T.IntegerType, T.LongType, T.StringType)) else value.cast("string")
        number = F.when(~F.isnan(value.cast("double")), value.cast("double")) if isinstance(kind, T.NumericType) else None
        text, no_sketch = (lambda c: c.cast("string") if plain else F.lit(None).cast("string")), F.lit(None).cast("binary")
        return F.struct(
            F.lit(field.name).alias("name"),
            F.count("*").alias("n_rows"),
            F.count(value).alias("n_filled"),
            text(F.min(value) if plain else value).alias("low"),
            text(F.max(value) if plain else value).alias("high"),
            (F.hll_sketch_agg(hashed) if countable else no_sketch).alias("distinct_sketch"),
            (F.kll_sketch_agg_double(number) if number is not None else no_sketch).alias("quantile_sketch"),
            F.lit(kind.simpleString()).alias("data_type"),
        )

    grouped = df.groupBy(*groups).agg(F.array(*[measures(f) for f in fields]).alias("_profiles"))
    names = [c for c in grouped.columns if c != "_profiles"]
    return grouped.select(*names, F.explode("_profiles").alias("p")).select(*names, "p.*")


def unite_profiles(profiles: DataFrame, *by: Column | str) -> DataFrame:
    """The profile of several groups together, or of the groups of `by`: of the same shape, so it can be united again."""
    numeric = F.first("data_type").rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$")

    def end(pick, text: Column) -> Column:
        """The least or greatest end; numbers are compared as such, exactly where they are whole."""
        whole, number = text.try_cast("decimal(38,0)"), text.try_cast("double")
        return F.when(numeric, pick(text, F.when(text.isNotNull(), F.struct(number, whole)))).otherwise(pick(text, text))

    return profiles.groupBy(*by, "name").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_filled").alias("n_filled"),
        end(F.min_by, F.col("low")).alias("low"),
        end(F.max_by, F.col("high")).alias("high"),
        F.when(F.count("distinct_sketch") > 0, F.hll_union_agg("distinct_sketch")).alias("distinct_sketch"),
        F.when(F.count("quantile_sketch") > 0, F.kll_merge_agg_double("quantile_sketch")).alias("quantile_sketch"),
        F.first("data_type").alias("data_type"),
    )


def read_profile(profiles: DataFrame, *quantiles: float) -> DataFrame:
    """What a stored or united profile says: the counts and ends (exact), `n_distinct` and `quantiles` (estimates, else null)."""
    distinct = F.when(F.col("distinct_sketch").isNotNull(), F.hll_sketch_estimate("distinct_sketch"))
    some = F.col("quantile_sketch").isNotNull() & (F.kll_sketch_get_n_double("quantile_sketch") > 0)
    at = F.when(some, F.kll_sketch_get_quantile_double("quantile_sketch", F.array(*[F.lit(float(q)) for q in quantiles])))
    kept = [c for c in profiles.columns if c not in ("distinct_sketch", "quantile_sketch")]
    return profiles.select(*kept, (F.col("n_rows") - F.col("n_filled")).alias("n_null"), distinct.alias("n_distinct"), *([at.alias("quantiles")] if quantiles else []))
