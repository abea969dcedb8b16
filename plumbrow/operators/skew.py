"""Joining rows to per-group results when one group may own a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

HOT_ROWS = 100_000  # rows of one group that one task is to hold
MOST_HOT = 1 << 20  # groups whose salts are broadcast at most, with 12 bytes each


def join_groups(
    rows: DataFrame, groups: DataFrame, on: Sequence[str], size: str, total: int, how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``rows`` with ``groups`` (one row per distinct ``on`` and its row count ``size``).

    A group above ``hot_rows`` rows is salted: its record is repeated once for every ``hot_rows`` of them and each of its rows meets one
    of the copies, so no task holds more of a group however large the table is. Rows learn the number of
    salts from a broadcast of key hashes, which are as long for wide keys as for narrow ones. Groups of that size are
    at most ``total / hot_rows``; the limit rises if these could be more than ``MOST_HOT``. ``how`` is ``inner``
    or ``left_semi``; rows whose vector has no group are dropped in both. Missing keys match each other.
    """
    limit = max(hot_rows, math.ceil(total / MOST_HOT), 1)
    hashed = F.xxhash64(*on)
    hot = (
        groups.filter(F.col(size) > limit).groupBy(hashed.alias("_hot"))
        .agg(F.max(F.ceil(F.col(size) / limit)).cast("int").alias("_salts"))
    )

    def salted(df: DataFrame) -> DataFrame:
        found = df.withColumn("_h", hashed).join(F.broadcast(hot), F.col("_h") == F.col("_hot"), "left")
        return found.withColumn("_salts", F.coalesce("_salts", F.lit(1))).drop("_hot")

    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_salts")).cast("int")
    left = salted(rows).withColumn("_salt", place)
    copies = salted(groups).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    named = copies.select(*[F.col(c).alias(f"g_{c}") for c in (*groups.columns, "_h", "_salt")])
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in on])
    joined = left.join(named, (F.col("_h") == F.col("g__h")) & (F.col("_salt") == F.col("g__salt")) & match, how)
    if how != "inner":
        return joined.select(*rows.columns)
    return joined.select(*rows.columns, *[F.col(f"g_{c}").alias(c) for c in groups.columns if c not in on])
