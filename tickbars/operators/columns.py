"""Columns that are dear to compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """`df` with a column that is computed once per row.

    The optimizer moves filters below projections and copies the expressions they refer to. For a
    parse that means doing it again for every reference, and generated methods so large that the JVM
    only interprets them. It does not move a filter below a generator whose output the filter uses.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))
