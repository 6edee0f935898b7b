"""Bringing older tables to the current schema and auditing keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samebytes import schemas as S
from samebytes.functions.common import as_timestamp
from samebytes.functions.predicates import Clock


def conform(df: DataFrame, table: str, now: Clock | None = None) -> DataFrame:
    """M1: exactly the table's columns and types; a projection, rows are kept.

    Absent columns get their default; columns the schema does not know are dropped. A table
    without its key column is refused. `now` fills absent times that may not be NULL.
    """
    schema, defaults = S.TABLES[table], S.COLUMN_DEFAULTS[table]
    key = schema[0].name
    if key not in df.columns:
        raise ValueError(f"{table} has no key column {key}")

    def column(field):
        if field.name in df.columns:
            return F.col(field.name)
        if field.name in defaults:
            return F.lit(defaults[field.name])
        if not field.nullable:
            if now is None or field.dataType.typeName() != "timestamp":
                raise ValueError(f"{table} has no column {field.name} and it has no default")
            return as_timestamp(now)
        return F.lit(None)

    return df.select(*[column(f).cast(f.dataType).alias(f.name) for f in schema])


def lower_enums(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """M2: enumerated columns in lower case."""
    names = set(columns)
    return df.select(*[F.lower(c).alias(c) if c in names else F.col(c) for c in df.columns])


def backfill_times(df: DataFrame, now: Clock) -> DataFrame:
    """M3: retry times of retryable rows from their execution time, audit times from each other."""
    clock = as_timestamp(now)
    retry = F.when(
        F.col("status") == "retryable", F.coalesce("retry_after", "execute_after")
    ).otherwise(F.col("retry_after"))
    return df.withColumns(
        {
            "retry_after": retry,
            "created_at": F.coalesce("created_at", clock),
            "updated_at": F.coalesce("updated_at", "created_at", clock),
        }
    )


def duplicate_keys(df: DataFrame, key: Iterable[str]) -> DataFrame:
    """Key values that occur more than once; NULLs never clash."""
    key = list(key)
    return (
        df.dropna(subset=key)
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .filter(F.col("row_count") > 1)
    )
