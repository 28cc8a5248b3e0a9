"""Columns that must be computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later filters read instead of repeating its expression.

    The optimizer moves a filter below the projection it refers to by writing the
    expression into the filter, once per mention.  A generator is not rewritten
    that way: a one-element explode evaluates the value exactly once per row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
