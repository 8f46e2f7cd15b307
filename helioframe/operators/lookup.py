"""Joins of a large table with a small one whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A registry row that reaches a join is a few short strings, so this many rows
# stay well under 100 MB per executor.
BROADCAST_ROWS = 500_000
# Copies of each registry row once it is too large to broadcast.
SALTS = 32


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when `df` is proven to hold at most `rows` rows (counting stops there)."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def lookup_join(facts: DataFrame, lookup: DataFrame, on: list[str], spread: str,
                rows: int = BROADCAST_ROWS, how: str = "inner") -> DataFrame:
    """Join `facts` with `lookup` without moving hot keys into one task.

    `how` is "inner", or "left" to keep facts that have no entry.

    A lookup of proven size is broadcast and `facts` does not shuffle. A larger
    one is joined by a shuffle on the key *and* a salt taken from `spread`, a
    column that varies within a key: a key with a third of all rows is then
    spread over `SALTS` partitions, each of which AQE may split further, and a
    later grouping on (key, spread) cannot inherit the skewed partitioning.
    """
    if is_small(lookup, rows):
        return facts.join(F.broadcast(lookup), on, how)
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return facts.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")
