"""Compute columns once, whatever is filtered on them later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """Add or replace columns behind a one-element generator.

    The optimizer rewrites a filter on a computed column in terms of its
    expression and so evaluates long rule chains and regular expressions twice,
    in code that soon is too large to compile.  It does not look through a
    generator, which itself stays in the same code-generated stage.
    """
    fenced = [value.alias(name) for name, value in columns.items()]
    kept = [c for c in df.columns if c not in columns and c not in drop]
    return df.select(*kept, F.inline(F.array(F.struct(*fenced))))
