"""Joins that look at sizes before they broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest lookup table that is broadcast: rows, and bytes of its text keys.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
#: Most keys that are broadcast: ids, or ids with a hash, of 48 bytes at most.
BROADCAST_KEYS = 1_000_000


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join a stored lookup table with one row per key.

    The lookup side is counted first: it is broadcast only within
    BROADCAST_ROWS and BROADCAST_BYTES. Beyond them both sides are shuffled,
    and adaptive execution splits the partitions of hot keys.
    """
    size = lookup.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(F.col(key).cast("string"))), F.lit(0)).alias("b")).first()
    if size.n <= BROADCAST_ROWS and size.b <= BROADCAST_BYTES:
        lookup = F.broadcast(lookup)
    return rows.join(lookup, key, how)


def checked_broadcast(keys: DataFrame) -> DataFrame:
    """Short keys, broadcast if they are counted to be few; else left to a shuffled join."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
