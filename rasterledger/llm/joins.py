"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A key with more than this share of all rows is joined as a broadcast: under a thousand keys.
LARGE_SHARE = 1000


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size: Column | str, total: int) -> DataFrame:
    """Left join of ``rows`` with one row of ``groups`` for each key.

    ``size`` is the number of rows that have the key. Keys with more than a thousandth of
    all ``total`` rows number less than a thousand whatever the input, so these are
    broadcast and their rows stay where they are; no other key has many rows.
    """
    size = F.col(size) if isinstance(size, str) else size
    large = size * LARGE_SHARE > F.lit(total)
    values = [c for c in groups.columns if c != key]
    hot = groups.where(large).withColumn("_hot", F.lit(True))
    met = rows.join(F.broadcast(hot), key, "left")
    rest = met.where(F.col("_hot").isNull()).drop("_hot", *values).join(groups.where(~large), key, "left")
    return rest.unionByName(met.where(F.col("_hot").isNotNull()).drop("_hot"))
