"""Insert-or-resolve of keyed rows, as a table operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLICIES = ("keep_first", "replace", "newest")


def check_policy(policy: str, version: Sequence[str] = ()) -> str:
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}, got {policy!r}")
    if (policy == "newest") != bool(version):
        raise ValueError("the policy newest, and no other, goes with version columns")
    return policy


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    policy: str = "replace",
    version: Sequence[str] = (),
) -> DataFrame:
    """`existing` with the rows of `incoming`; on equal keys `policy` says which of the two stays.

    `newest` keeps the row whose `version` columns are greater, compared in their order with null as the least, and the
    incoming one if they are equal. In whatever order, and however often, sets of rows come in, the outcome is the same.

    Both sides have to be unique by key and without null keys. The full outer join evaluates each
    side once and shuffles it once, where anti-join plus union would evaluate one of them twice; the
    keys are unique, so no join key is hot. Narrow `existing` to the partitions that `incoming` touches
    first (see `sinks.merge_candles`).
    """
    check_policy(policy, version)
    keys = list(keys)
    if set(existing.columns) != set(incoming.columns):
        raise ValueError(f"columns differ: {existing.columns} and {incoming.columns}")
    first, second = (existing, incoming) if policy == "keep_first" else (incoming, existing)
    first, second = first.withColumn("_here", F.lit(True)).alias("a"), second.withColumn("_there", F.lit(True)).alias("b")
    joined = first.join(second, keys, "full_outer")
    wins = F.col("a._here")
    if policy == "newest":
        of = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in version])
        wins = F.col("a._here") & (F.col("b._there").isNull() | (of("a") >= of("b")))
    return joined.select(
        *[
            F.col(c) if c in keys else F.when(wins, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
            for c in existing.columns
        ]
    )
