"""Registry of named queries: a Spark callable and, where one exists, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendcadence.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator id."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: flat(fn(tune(spark), sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def flat(df: DataFrame) -> DataFrame:
    """Dates as ISO text and decimals as doubles, so that results compare across engines."""
    changed = {}
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind == "date":
            changed[field.name] = F.date_format(F.col(field.name), "yyyy-MM-dd")
        elif kind == "decimal":
            changed[field.name] = F.col(field.name).cast("double")
    return df.withColumns(changed) if changed else df
