"""Distributions of batch sizes and times, as sketches that can be put together.

A sketch of a few KB per service and day stands for any number of batches. With k, ranks are off by about 2.3 / k^0.9 of
the batches (0.4 % for the default); up to k batches, quantiles are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 1024


def value_sketches(rows: DataFrame, value: str, by: Sequence[str], k: int = K) -> DataFrame:
    """A sketch of a bigint column per group, with `n`, the number of values; nulls don't count."""
    sketch = F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), F.lit(k)).alias("sketch")
    return rows.groupBy(*by).agg(sketch, F.count(value).alias("n"))


def merge_sketches(sketches: DataFrame, by: Sequence[str], k: int = K) -> DataFrame:
    """One sketch of all those of a group."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))


def quantile_of(share: float, sketch: str = "sketch") -> Column:
    """The least value that so large a share of the values does not exceed."""
    return F.kll_sketch_get_quantile_bigint(F.col(sketch), F.lit(share))
