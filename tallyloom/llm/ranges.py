"""Dealing rows out by ranges of a numeric key, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_count(df: DataFrame, per_partition: int = 4) -> int:
    """Ranges to cut a key into: several for each shuffle partition, so that hashing them evens out."""
    return per_partition * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bounds(keys: DataFrame, column: str, ranges: int) -> list[int]:
    """At most ``ranges - 1`` ascending bounds that cut the long ``column`` into about equal counts; nulls are left out.

    They come from Spark's quantile sketch over the key column alone; the sketch and the bounds have a fixed size.
    """
    parts = [k / ranges for k in range(1, ranges)]
    found = keys.stat.approxQuantile(column, parts, 1 / (4 * ranges)) if parts else []
    return sorted({int(x) for x in found})


def range_of(key: Column, cuts: list[int]) -> Column:
    """1 + the number of ``cuts`` below ``key``, by binary search; 0 for a null key."""
    if not cuts:
        return F.when(key.isNull(), 0).otherwise(1).cast("int")
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    array = F.array(*[F.lit(x).cast("long") for x in cuts])
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(F.try_element_at(array, low + step) < key, low + step).otherwise(low))
    return F.when(key.isNull(), 0).otherwise(below + 1).cast("int")
