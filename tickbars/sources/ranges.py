"""Ranges of a column that hold about equally many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cuts are off by one in so many rows at most.
ACCURACY = 10_000


def cut_points(df: DataFrame, column: str, n: int, accuracy: int = ACCURACY) -> list[int | float]:
    """At most n - 1 ascending cuts between n ranges of about equally many rows, from a sketch of the quantiles.

    One pass with partial aggregation. A value that has more rows than a range has makes fewer, larger ranges.
    """
    shares = [i / n for i in range(1, n)]
    if not shares:
        return []
    found = df.agg(F.percentile_approx(column, shares, accuracy)).first()[0]
    return sorted(set(found or []))


def predicates_at(column: str, cuts: list[int | float]) -> list[str]:
    """SQL predicates of the ranges between cuts. Each row, those with NULL too, is in exactly one of them."""
    if not cuts:
        return ["1 = 1"]
    first = f"({column} < {cuts[0]} or {column} is null)"
    return [first, *(f"{column} >= {a} and {column} < {b}" for a, b in zip(cuts, cuts[1:])), f"{column} >= {cuts[-1]}"]


def range_predicates(df: DataFrame, column: str, n: int) -> list[str]:
    """Predicates that share out the rows of a frame by a numeric column into n parts of about one size, or fewer."""
    return predicates_at(column, cut_points(df, column, n))
